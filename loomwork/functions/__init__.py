from loomwork.functions.text import (
    base64_text,
    decode_base64,
    default_value,
    display_name,
    first_group,
    first_non_empty,
    last_token,
    member_flag,
    nth_field,
    route_by_shape,
)

__all__ = [
    "base64_text",
    "decode_base64",
    "default_value",
    "display_name",
    "first_group",
    "first_non_empty",
    "last_token",
    "member_flag",
    "nth_field",
    "route_by_shape",
]
