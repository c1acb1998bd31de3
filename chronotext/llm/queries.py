"""The registered queries of this folder, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, common, exact_dedup, fingerprints, mixing, near_dedup, prefix_trie, quality, resampling, secret_scan, sentence_pieces, substring_dedup, token_table, url_filter

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
NORM_SQL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each removed run of repeats; the first occurrence of a passage isn't listed."""
    return substring_dedup.find_repeats(common.table(spark, sf_dir, "documents")).drop("uid")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.read_back(chat_format.format_turns(turns.unionByName(own)))


OP2_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(n, r)),
e AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS own,
  24 + length(role) + length(text) + len(regexp_extract_all(text, '\\|<\|')) + len(regexp_extract_all(role, '\\|<\||\n')) AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(length(own))::BIGINT AS loss_chars, sha256(string_agg(own, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, 0::BIGINT AS rewrites FROM e GROUP BY conv_id
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mixing.plan(common.table(spark, sf_dir, "documents"))
    return p.select(F.col("id").alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"))


OP3_SQL = f"""
WITH d AS (SELECT doc_id, source, text, len({WORDS_SQL})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT AS weight FROM s),
r AS (SELECT *, source_size / weight AS ratio, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS weights,
  3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped_before,
  coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS weights_before
  FROM w WINDOW o AS (ORDER BY source_size / weight, source IS NULL, source)),
f AS (SELECT *, total - capped_before AS rest, weights - weights_before AS weights_rest FROM r),
l AS (SELECT arg_min(rest, ratio) AS rest, arg_min(weights_rest, ratio) AS weights_rest, min(ratio) AS ratio
  FROM f WHERE rest * weight <= 3 * source_size * weights_rest),
t AS (SELECT source, source_size, CASE WHEN f.ratio < l.ratio THEN (3 * source_size)::DOUBLE ELSE l.rest * weight / l.weights_rest END AS target FROM f, l),
m AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, md5(coalesce(d.text, '')))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + (u < rate - floor(rate))::INT)::BIGINT * size)::BIGINT AS taken FROM m
"""


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find_near_copies(common.table(spark, sf_dir, "documents"))


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentence_pieces.encode(common.table(spark, sf_dir, "documents"), sentence_pieces.model_path())
    return coded.select("doc_id", "n_tokens", F.crc32(F.concat_ws(",", "ids").cast("binary")).alias("ids_crc32"), "decoded_sha256", "exact")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(common.table(spark, sf_dir, "documents"))


OP6_SQL = f"""
WITH d AS (SELECT doc_id, length(coalesce(text, ''))::BIGINT AS points, {NORM_SQL} AS norm FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
  first_value(points) OVER (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST) AS keep_points,
  count(*) OVER (PARTITION BY norm)::BIGINT AS group_size FROM d)
SELECT doc_id, keep_id, group_size, (doc_id IS NOT DISTINCT FROM keep_id AND points = keep_points) AS kept, sha256(norm) AS text_sha256 FROM r
"""


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(common.table(spark, sf_dir, "documents"))


def op8_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    read = token_table.read_tokens(token_table.write_tokens(docs, token_table.tokenizer_path(), end_id=2))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    trees = quality.learn(docs, common.table(spark, sf_dir, "labels"))
    scored = quality.score(docs, trees)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(common.table(spark, sf_dir, "documents"))
    base, both = F.col("base"), F.array_sort(F.concat("base", "added"))
    n = [secret_scan.count_of(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *n, F.sha2(secret_scan.written_as(base), 256).alias("base_sha256"), secret_scan.written_as(both).alias("spans"))


def _op9_sql() -> str:
    """Places come from lengths of pieces and matches; windows are counted anew, not
    incrementally, and joined to spans by gaps between their starts."""

    def spans(kind: str, pattern: str, keep: str, group: int = 0, text: str = "text") -> str:
        own = f"regexp_extract_all({text}, '{pattern}', {group})"
        return f"""SELECT row, '{kind}' AS kind, gaps + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS start, m[i] AS hit, o[i] AS own FROM (
          SELECT row, m, o, i, list_sum(list_transform(p[:i], lambda x: length(x))) AS gaps FROM (
            SELECT row, m, o, p, unnest(range(1, len(m) + 1)) AS i FROM (
              SELECT row, regexp_extract_all({text}, '{pattern}') AS m, {own} AS o, regexp_split_to_array({text}, '{pattern}') AS p FROM d) WHERE len(m) > 0)) WHERE {keep}"""

    q = lambda x: x.replace("'", "''").replace("(?i:(", "(?i:(")
    parts = [
        spans("assign", q(secret_scan.ASSIGN), f"length(o[i]) >= {secret_scan.LEAST_ASSIGN}", 2),
        spans("access", "AKIA[A-Z0-9]+", f"length(m[i]) >= {secret_scan.LEAST_ACCESS}"),
        spans("hex", "[0-9a-f]+", f"length(m[i]) >= {secret_scan.LEAST_HEX}"),
    ]
    w, runs, ctes = secret_scan.WINDOW, [], []
    for kind, (characters, least) in secret_scan.CLASSES.items():
        run = secret_scan._class(characters)
        allowed = " OR ".join(f"regexp_matches(m[i], '{q(a)}')" for a in secret_scan.ALLOWED)
        ctes.append(f"{kind}_c AS ({spans(kind, f'{run}{{{w},}}', f'NOT ({allowed})', text='bare')})")
        ctes.append(f"""{kind}_w AS (SELECT row, kind, start, p, string_split(substr(hit, p, {w}), '') AS c FROM (SELECT *, unnest(range(1, length(hit) - {w} + 2)) AS p FROM {kind}_c))""")
        ctes.append(f"""{kind}_h AS (SELECT row, kind, start, p FROM {kind}_w WHERE
          list_sum(list_transform(list_distinct(c), lambda x: -(len(list_filter(c, lambda y: y = x)) / {w}) * log2(len(list_filter(c, lambda y: y = x)) / {w}))) >= {least} - 1e-9)""")
        ctes.append(f"""{kind}_g AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY row, start ORDER BY p) <= {w} THEN 0 ELSE 1 END AS fresh FROM {kind}_h)""")
        ctes.append(f"""{kind}_s AS (SELECT row, kind, start + min(p) - 1 AS a, start + max(p) - 1 + {w} AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY row, start ORDER BY p) AS g FROM {kind}_g) GROUP BY row, kind, start, g)""")
        runs.append(f"SELECT row, kind, a, b FROM {kind}_s")
    order = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(secret_scan.KINDS))
    bare = "text"
    for part in secret_scan.BLANKED:
        bare = f"regexp_replace({bare}, '(?i){part}', '{' ' * len(part)}', 'g')"
    return f"""
WITH d AS (SELECT *, {bare} AS bare FROM (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents)),
b AS (SELECT row, kind, start AS a, start + length(hit) AS b FROM ({" UNION ALL ".join(parts)})),
{", ".join(ctes)},
u AS (SELECT *, CASE kind {order} END AS place FROM (SELECT * FROM b UNION ALL {" UNION ALL ".join(runs)})),
s AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(concat_ws(':', kind, a::BIGINT, b::BIGINT), ',' ORDER BY a, place, b) FILTER (place < 3) AS base,
  string_agg(concat_ws(':', kind, a::BIGINT, b::BIGINT), ',' ORDER BY a, place, b) AS spans FROM u GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (row)
"""


#: The rules of op11's contract: (verdict, host and path).
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(common.table(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"])
    return judged.select("row.page_id", "host", "path", "rule", "verdict", "score")


def _op11_sql() -> str:
    """The same counts, estimates and threshold, each as a table."""
    k, least = url_filter.ORDER, url_filter.LEAST_SEEN
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(URL_RULES, key=lambda r: -len(r[1]))
    case = lambda own: "CASE " + " ".join(f"WHEN {fits(r.split('/')[0], r[len(r.split('/')[0]):])} THEN '{v if own else r}'" for v, r in longest) + " END"
    mixed = lambda c, below: f"CASE WHEN coalesce(n{c}, 0) >= {least} THEN (coalesce(c.{c}, 0) + t{c} * {below}) / (n{c} + t{c}) ELSE {below} END AS p{c}"
    levels = []
    for n in range(1, k + 2):
        below = {c: f"b.p{c}" if n > 1 else "1.0::DOUBLE / (SELECT count(*) + 1 FROM counts WHERE length(gram) = 1)" for c in "ab"}
        levels.append(f"""p{n} AS (SELECT w.gram, {mixed('a', below['a'])}, {mixed('b', below['b'])} FROM (SELECT DISTINCT right(gram, {n}) AS gram FROM symbols) w
          LEFT JOIN counts c ON c.gram = w.gram LEFT JOIN contexts x ON x.context = w.gram[:-2] AND x.n = {n} {f"JOIN p{n - 1} b ON b.gram = w.gram[2:]" if n > 1 else ""})""")
    return rf"""
WITH u AS (SELECT page_id, row_number() OVER () AS uid, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '{url_filter.HOST}', 1), '{url_filter.UPPER}', '{url_filter.UPPER.lower()}') AS host, regexp_extract(coalesce(url, ''), '{url_filter.PATH}', 1) AS path FROM pages),
r AS (SELECT *, {case(False)} AS rule, {case(True)} AS verdict, substr(md5(url), 1, 1) IN ('0', '1') AS held FROM u),
g AS (SELECT uid, rule, verdict, held, unnest(list_transform(range(1, length(url) + 2), lambda i: substr(repeat(chr(2), {k}) || url || chr(3), i, {k + 1}))) AS gram FROM r),
counts AS (SELECT right(gram, e.n::BIGINT) AS gram, (count(*) FILTER (verdict = 'allow'))::BIGINT AS a, (count(*) FILTER (verdict = 'block'))::BIGINT AS b FROM g, range(1, {k + 2}) e(n) WHERE rule IS NOT NULL AND NOT held GROUP BY 1),
contexts AS (SELECT gram[:-2] AS context, length(gram) AS n, sum(a)::BIGINT AS na, sum(b)::BIGINT AS nb, count(*) FILTER (a > 0) AS ta, count(*) FILTER (b > 0) AS tb FROM counts GROUP BY 1, 2),
symbols AS (SELECT uid, gram FROM g WHERE rule IS NULL OR held),
{", ".join(levels)},
s AS (SELECT uid, greatest(-{url_filter.FARTHEST}, least({url_filter.FARTHEST}, floor(sum(floor((ln(pa) - ln(pb)) * {url_filter.UNIT} + 0.5)::BIGINT) / (count(*) * {url_filter.UNIT / 1000}))))::BIGINT AS score FROM symbols JOIN p{k + 1} USING (gram) GROUP BY uid),
h AS (SELECT score, count(*) FILTER (verdict = 'allow') AS a, count(*) FILTER (verdict = 'block') AS b FROM r JOIN s USING (uid) WHERE held AND rule IS NOT NULL GROUP BY 1 UNION ALL SELECT 0, 0, 0),
t AS (SELECT score, (sum(a) OVER (ORDER BY score RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT * sum(b) OVER () + (sum(b) OVER () - sum(b) OVER (ORDER BY score RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT * sum(a) OVER () AS right_ones, sum(a) OVER () AS a, sum(b) OVER () AS b FROM h),
l AS (SELECT CASE WHEN max(a) = 0 OR max(b) = 0 THEN 0 ELSE arg_min(score, (-right_ones, abs(score), score)) END AS least FROM t)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN verdict WHEN score >= least THEN 'allow' ELSE 'block' END AS verdict, CASE WHEN rule IS NULL THEN score END AS score FROM r LEFT JOIN s USING (uid), l
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def _crc_sql(text: str) -> str:
    """crc32 of a text's bytes; the byte table is column of the one-row table crc_table."""
    byte = f"list_transform(range(0, length(hex(encode({text}))) // 2), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::BIGINT, 2))::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])))"


CRC_TABLE = "crc_table AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS crcs FROM range(256) t(b))"
OP12_SQL = rf"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS own FROM documents),
f AS (SELECT uid, w, count(*) AS n FROM (SELECT uid, unnest(own) AS w FROM d) GROUP BY ALL),
g AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY ALL),
b AS (SELECT w, {_crc_sql("w")} % {resampling.BUCKETS} AS bucket FROM (SELECT w FROM f UNION SELECT w FROM g), crc_table),
c AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM (SELECT w, n AS s, 0 AS t FROM f UNION ALL SELECT w, 0, n FROM g) JOIN b USING (w) GROUP BY 1),
k AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {resampling.BUCKETS}) / ((s + 1)::DOUBLE * (sum(t) OVER () + {resampling.BUCKETS}))))::BIGINT AS gain FROM c),
w AS (SELECT uid, sum(n * gain)::BIGINT AS weight FROM f JOIN b USING (w) JOIN k USING (bucket) GROUP BY 1),
s AS (SELECT uid, doc_id, len(own)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{resampling.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (uid)),
r AS (SELECT uid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM s WHERE n_features >= {resampling.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {resampling.PERCENT} * n // 100 THEN rank END AS rank FROM s LEFT JOIN r USING (uid)
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(common.table(spark, sf_dir, "conversations"))


OP13_SQL = f"""
WITH {CRC_TABLE},
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place, (coalesce(role, ''), coalesce(text, '')) AS item FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, conv_id - conv_id % {prefix_trie.FAMILY} AS base, {_crc_sql("conv_id::VARCHAR")} % {prefix_trie.MOST_SHARED + 1} AS h FROM (SELECT DISTINCT conv_id FROM t), crc_table),
l AS (SELECT conv_id, list(item ORDER BY place) AS items FROM t GROUP BY 1),
r AS (SELECT i.conv_id, coalesce(b.items[:h], []) || o.items[h + 1:] AS items FROM i JOIN l o USING (conv_id) LEFT JOIN l b ON b.conv_id = i.base),
m AS (SELECT conv_id, unnest(range(0, len(items) + 1)) AS depth, items FROM r),
n AS (SELECT items[:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(octet_length(encode(items[depth][2])), 0) AS size,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(items) = depth), '')) AS ends_sha256 FROM (SELECT conv_id, items, depth, items[:depth] AS prefix FROM m) GROUP BY ALL),
k AS (SELECT *, (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND x.prefix[:n.depth] = n.prefix) AS n_children FROM n)
SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, s.n_leaves, s.saved_tokens, a.ends_sha256
FROM k a LEFT JOIN n p ON p.depth = a.depth - 1 AND p.prefix = a.prefix[:a.depth - 1]
JOIN (SELECT u.prefix, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.size)::BIGINT AS saved_tokens FROM n u JOIN k v ON v.depth >= u.depth AND v.prefix[:u.depth] = u.prefix GROUP BY 1) s ON s.prefix = a.prefix
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_substring_dedup": op1_substring_dedup, "op2_chat_format": op2_chat_format, "op3_mixing": op3_mixing, "op4_minhash_near_dedup": op4_minhash_near_dedup, "op5_sentence_pieces": op5_sentence_pieces, "op6_exact_dedup": op6_exact_dedup, "op7_fingerprints": op7_fingerprints, "op8_token_table": op8_token_table, "op9_secret_scan": op9_secret_scan, "op10_quality_classifier": op10_quality_classifier, "op11_url_filter": op11_url_filter, "op12_importance_resampling": op12_importance_resampling, "op13_prefix_trie": op13_prefix_trie}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2_SQL, "op3_mixing": OP3_SQL, "op6_exact_dedup": OP6_SQL, "op9_secret_scan": _op9_sql(), "op11_url_filter": _op11_sql(), "op12_importance_resampling": OP12_SQL, "op13_prefix_trie": OP13_SQL}
