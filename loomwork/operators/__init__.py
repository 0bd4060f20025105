from loomwork.operators.lines import explode_lines, first_match_per_row, keep_links
from loomwork.operators.records import download_list, lines_to_json, link_text, node_record, pretty_json, to_json_record

__all__ = [
    "download_list",
    "explode_lines",
    "first_match_per_row",
    "keep_links",
    "lines_to_json",
    "link_text",
    "node_record",
    "pretty_json",
    "to_json_record",
]
