"""Queries of the text and record operators. Each is one narrow stage unless its docstring says otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import (
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
from loomwork.functions.text import TLS_PORTS
from loomwork.operators import (
    download_list,
    explode_lines,
    first_match_per_row,
    keep_links,
    lines_to_json,
    link_text,
    node_record,
    pretty_json,
    to_json_record,
)
from loomwork.operators.records import arch_class
from loomwork.sources import read_lines, read_table, read_whole_text, shared_folder, write_json, write_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
HOST = r"https?://([^ ]*example\.com)/?"


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


@query(r"""SELECT page_id, regexp_extract(url, 'https?://([^ ]*example\.com)/?', 1) AS host
FROM pages WHERE regexp_matches(url, '(http|https)://') AND regexp_matches(url, 'https?://([^ ]*example\.com)/?')""")
def url_scheme_filter_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    url = F.col("url")
    kept = pages.where(url.rlike("(http|https)://"))
    return kept.select("page_id", first_group(url, HOST).alias("host")).where(F.col("host").isNotNull())


@query("""SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS line_no, unnest(l) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_lines(read_table(spark, sf_dir, "documents"), "text", ["doc_id"])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    return events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'true' ELSE '' END AS flag,
CASE WHEN CAST(2050 + user_id % 50 AS VARCHAR) IN ('443', '8443', '2096', '2087', '2083', '2053') THEN 'tls' ELSE '' END AS port_flag
FROM events""")
def member_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ports are derived from the users so that some are in the set."""
    events = read_table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        member_flag(F.col("event_type"), ("click", "view"), "true").alias("flag"),
        member_flag((F.col("user_id") % 50 + 2050).cast("string"), TLS_PORTS).alias("port_flag"),
    )


@query("""SELECT page_id, CASE WHEN u IS NULL THEN NULL WHEN contains(u, ':') THEN list_extract(string_split(u, ':'), -1) ELSE '' END AS last
FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN replace(url, ':', ' ') ELSE url END AS u FROM pages)""")
def last_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One url in three loses its separators."""
    url = F.when(F.col("page_id") % 3 == 0, F.replace("url", F.lit(":"), F.lit(" "))).otherwise(F.col("url"))
    return read_table(spark, sf_dir, "pages").select("page_id", last_token(url).alias("last"))


@query("SELECT page_id, list_extract(string_split(html, '\"'), 12) AS field FROM pages")
def nth_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", nth_field(F.col("html"), '"', 11).alias("field"))


SHAPED = """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN replace(replace(to_base64(encode(text)), '+', 'A'), '/', 'B')
WHEN turn % 3 = 1 THEN concat('{"TunnelSecret": "', role, '"}') ELSE text END AS auth FROM conversations"""


@query(f"""SELECT conv_id, turn, CASE WHEN regexp_matches(auth, '^[A-Z0-9a-z=]{{120,250}}$') THEN 'token'
WHEN contains(auth, 'TunnelSecret') THEN 'secret' ELSE 'default' END AS route FROM ({SHAPED})""")
def route_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The input is derived from the turns so that every route has rows, tokens of 251 letters and more among them."""
    t = read_table(spark, sf_dir, "conversations")
    token = F.translate(base64_text(F.col("text")), "+/", "AB")
    secret = F.concat(F.lit('{"TunnelSecret": "'), F.col("role"), F.lit('"}'))
    auth = F.when(F.col("turn") % 3 == 0, token).when(F.col("turn") % 3 == 1, secret).otherwise(F.col("text"))
    return t.select("conv_id", "turn", auth.alias("auth")).select("conv_id", "turn", route_by_shape(F.col("auth")).alias("route"))


@query("""SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN NULL ELSE lang END, ''), 'en') AS lang FROM documents""")
def default_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    lang = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 2, F.col("lang"))
    return d.select("doc_id", default_value(lang, "en").alias("lang"))


@query("""SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END, ''), nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), '3000') AS port FROM documents""")
def first_non_empties(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    a = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source"))
    b = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    return d.select("doc_id", first_non_empty(a, b, F.lit("3000")).alias("port"))


GUARDED = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS a, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS b FROM documents"


@query(f"""SELECT doc_id, (coalesce(a, '') <> '' AND coalesce(b, '') <> '') AS both_set, (a IS NULL OR a = '' OR b IS NULL OR b = '') AS one_missing
FROM ({GUARDED})""")
def set_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values are taken from some rows so that either may be missing."""
    d = read_table(spark, sf_dir, "documents")
    a, b = F.when(F.col("doc_id") % 3 != 0, F.col("source")), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("lang"))
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    return d.select("doc_id", (full(a) & full(b)).alias("both_set"), (~full(a) | ~full(b)).alias("one_missing"))


@query("""SELECT conv_id, turn, concat('vless://', role, '@conv', CAST(conv_id AS VARCHAR), '.example.com:', CAST(443 + turn AS VARCHAR), '#', text) AS link FROM conversations""")
def template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit(".example.com"))
    link = link_text("vless", F.col("role"), host, F.col("turn") + 443, F.col("text"))
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", link.alias("link"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN concat(role, '-', trim(concat('  ', text, ' '))) ELSE trim(concat('  ', text, ' ')) END AS name FROM conversations""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("")
    suffix = F.concat(F.lit("  "), F.col("text"), F.lit(" "))
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", display_name(name, suffix).alias("name"))


@query("SELECT conv_id, turn, to_base64(encode(text)) AS code FROM conversations")
def base64_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", base64_text(F.col("text")).alias("code"))


@query("SELECT conv_id, turn, decode(from_base64(to_base64(encode(text)))) AS text FROM conversations")
def base64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", decode_base64(base64_text(F.col("text"))).alias("text"))


@query("""SELECT conv_id, turn, line_no, line FROM (SELECT conv_id, turn, CAST(unnest(range(len(l))) AS INTEGER) AS line_no, unnest(l) AS line
FROM (SELECT conv_id, turn, string_split(concat('vmess://', text, chr(10), 'no link', chr(10), role, ' trojan://x'), chr(10)) AS l FROM conversations))
WHERE regexp_matches(line, '(vless|vmess|trojan|hysteria2|tuic)://')""")
def subscription_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "conversations")
    body = F.concat(F.lit("vmess://"), F.col("text"), F.lit("\nno link\n"), F.col("role"), F.lit(" trojan://x"))
    return keep_links(t.select("conv_id", "turn", base64_text(body).alias("sub")), "sub", ["conv_id", "turn"])


@query("""SELECT event_id, CAST(json_object('v', '2', 'type', event_type, 'user', user_id, 'none', NULL) AS VARCHAR) AS record FROM events""")
def record_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"v": F.lit("2"), "type": F.col("event_type"), "user": F.col("user_id"), "none": F.lit(None).cast("string")}
    return read_table(spark, sf_dir, "events").select("event_id", to_json_record(fields).alias("record"))


@query("""SELECT event_id, to_base64(encode(CAST(json_object('v', '2', 'ps', event_type, 'id', CAST(user_id AS VARCHAR)) AS VARCHAR))) AS record FROM events""")
def node_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"ps": F.col("event_type"), "id": F.col("user_id").cast("string")}
    return read_table(spark, sf_dir, "events").select("event_id", node_record(fields).alias("record"))


@query("""SELECT page_id, CAST(json_object('log', json_object('level', 'none'), 'inbounds', json_array(json_object('tag', url, 'port', page_id % 65536))) AS VARCHAR) AS config FROM pages""")
def config_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    inbound = F.struct(F.col("url").alias("tag"), (F.col("page_id") % 65536).alias("port"))
    fields = {"log": F.struct(F.lit("none").alias("level")), "inbounds": F.array(inbound)}
    return read_table(spark, sf_dir, "pages").select("page_id", to_json_record(fields).alias("config"))


@query("""SELECT conv_id, CAST(json_object('nodes', list(role ORDER BY turn, role)) AS VARCHAR) AS body FROM conversations GROUP BY conv_id""")
def nodes_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shuffle on the conversation; its turns meet in one row."""
    return lines_to_json(read_table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role")


@query(r"""SELECT doc_id, regexp_extract(line, 'the ([a-z]+ed)', 1) AS match FROM (SELECT doc_id, arg_min(line, n) AS line FROM
(SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
WHERE regexp_matches(line, 'the ([a-z]+ed)') GROUP BY doc_id)""")
def first_match_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_match_per_row(read_table(spark, sf_dir, "documents"), "text", "the ([a-z]+ed)", ["doc_id"])


MACHINE = "CASE doc_id % 4 WHEN 0 THEN 'arm64' WHEN 1 THEN 'x64' WHEN 2 THEN 'aarch64' END"


@query(f"SELECT doc_id, CASE WHEN {MACHINE} IN ('arm', 'arm64', 'aarch64') THEN 'arm' ELSE 'amd' END AS arch FROM documents")
def arch_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", arch_class(F.expr(MACHINE)).alias("arch"))


@query(f"""SELECT doc_id, unnest(f).file_name AS file_name, unnest(f).file_url AS file_url FROM (SELECT doc_id, CASE WHEN lang = 'en'
THEN list_concat([{{'file_name': 'agent', 'file_url': concat(root, lang)}}], files) ELSE files END AS f FROM
(SELECT doc_id, lang, root, [{{'file_name': 'web', 'file_url': concat(root, 'web')}}, {{'file_name': 'bot', 'file_url': concat(root, 'bot')}}] AS files FROM
(SELECT doc_id, lang, concat('https://', source, '.example.com/', CASE WHEN {MACHINE} IN ('arm', 'arm64', 'aarch64') THEN 'arm' ELSE 'amd' END, '/') AS root FROM documents)))""")
def download_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    base = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com"))
    agent = F.when(F.col("lang") == "en", F.col("lang"))
    return d.select("doc_id", F.inline(download_list(F.expr(MACHINE), base, agent)))


@query(f"""SELECT doc_id, unnest(f).file_name AS file_name, unnest(f).file_url AS file_url FROM (SELECT doc_id, CASE WHEN lang = 'en'
THEN list_concat(files, [{{'file_name': 'agent', 'file_url': concat(root, lang)}}]) ELSE files END AS f FROM
(SELECT doc_id, lang, root, [{{'file_name': 'web', 'file_url': concat(root, 'web')}}, {{'file_name': 'bot', 'file_url': concat(root, 'bot')}}] AS files FROM
(SELECT doc_id, lang, concat('https://', source, '.example.com/', CASE WHEN {MACHINE} IN ('arm', 'arm64', 'aarch64') THEN 'arm' ELSE 'amd' END, '/') AS root FROM documents)))""")
def download_lists_agent_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    base = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com"))
    agent = F.when(F.col("lang") == "en", F.col("lang"))
    return d.select("doc_id", F.inline(download_list(F.expr(MACHINE), base, agent, agent_first=False)))


@query(r"""SELECT page_id, concat('{', chr(10), '  "log": {', chr(10), '    "level": "none"', chr(10), '  },', chr(10), '  "inbounds": [', chr(10), '    {', chr(10),
'      "tag": ', coalesce(CAST(to_json(url) AS VARCHAR), 'null'), ',', chr(10), '      "port": ', page_id % 65536, chr(10), '    }', chr(10), '  ],', chr(10), '  "rules": []', chr(10), '}') AS config FROM pages""")
def config_json_pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    inbound = {"tag": F.col("url"), "port": F.col("page_id") % 65536}
    config = pretty_json({"log": {"level": F.lit("none")}, "inbounds": [inbound], "rules": []})
    return read_table(spark, sf_dir, "pages").select("page_id", config.alias("config"))


@query("""SELECT conv_id, turn, to_base64(encode(concat('vless://', role, chr(10), 'vmess://',
to_base64(encode(CAST(json_object('v', '2', 'ps', text, 'id', role) AS VARCHAR)))))) AS sub FROM conversations""")
def subscription_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record encoded inside a text of links, and the text encoded again."""
    record = node_record({"ps": F.col("text"), "id": F.col("role")})
    body = F.concat(F.lit("vless://"), F.col("role"), F.lit("\nvmess://"), record)
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", base64_text(body).alias("sub"))


@query("""SELECT line, count(*) AS n FROM (SELECT unnest(string_split(concat(role, chr(10), text), chr(10))) AS line FROM conversations) GROUP BY line""")
def text_file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as text files and read again by lines."""
    path = shared_folder(spark)
    write_text(read_table(spark, sf_dir, "conversations").select(F.concat("role", F.lit("\n"), "text").alias("value")), path)
    return read_lines(spark, path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("""SELECT role, count(*) AS n_lines, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM conversations GROUP BY role""")
def text_file_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of text files a role, each file read whole."""
    path = shared_folder(spark)
    turns = read_table(spark, sf_dir, "conversations").select("role", F.replace("text", F.lit("\n"), F.lit(" ")).alias("value"))
    turns.write.mode("overwrite").partitionBy("role").text(path)
    whole = read_whole_text(spark, path)
    return whole.groupBy("role").agg(
        F.sum(F.regexp_count("value", F.lit("\n"))).cast("long").alias("n_lines"), F.sum(F.char_length("value")).cast("long").alias("n_chars"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS kind FROM events""")
def json_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON lines, nulls kept, and read again."""
    path = shared_folder(spark)
    write_json(read_table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("kind")), path)
    return spark.read.schema("event_id long, kind string").json(path)
