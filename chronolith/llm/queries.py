"""The registered queries of these operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact, licenses, packing, quality, secret_scan, simhash, token_store, urls

BYTE_BPE, BYTE_END = "byte_bpe_50k.json", 2
WORD_BPE, WORD_END = "word_bpe_49k.json", 1


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.store(_table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
        (F.col("failed_bits").bitwiseAND(F.lit(quality.BASE)) != 0).alias("base_failed"), quality.passes().alias("kept"), "failed_bits",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each policy and rule: documents that fail it, and that fail it alone, from one stored ledger."""
    rows = quality.store(_table(spark, sf_dir, "documents"), ["doc_id"])
    first, *more = [quality.ablation(rows, version) for version in sorted(quality.POLICIES)]
    for frame in more:
        first = first.unionByName(frame)
    return first


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.classify(_table(spark, sf_dir, "pages"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read(token_store.write(_table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), BYTE_END))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary(WORD_BPE), WORD_END).drop("ids")


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import cut

    text = F.lit("\\### Assistant: </turn> ok")
    turns = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role")) for t, r in ((0, "user"), (1, "assistant"))]))
    extra = spark.range(1).select(turns.alias("t")).select(F.lit(-7).cast("long").alias("conv_id"), "t.turn", "t.role", text.alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(cut(chat.windows(rows)))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_secret_scan, op2_quality_rules, op3_url_filter, op4_token_store, op5_packing, op6_chat_windows, op7_exact_dedup, op8_bpe, op9_simhash, op10_license_scan)
    return {f.__name__: f for f in (*ops, quality_ablation)}


def _op3_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)
    labels = ", ".join(f"'{x}'" for x in urls.BAD_LABELS)
    pattern = "^[\\s\\S]*?://([^/?#]*)([^?#]*)"
    return f"""
WITH rules(v, h, p) AS (VALUES {rules}),
parts AS (SELECT page_id,
  translate(coalesce(regexp_extract(url, '{pattern}', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
  coalesce(regexp_extract(url, '{pattern}', 2), '') AS path FROM pages),
fit AS (SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(p) DESC, length(h) DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT parts.page_id, host, path, rule,
  coalesce(v, CASE WHEN list_has_any(string_split(host, '.'), [{labels}]) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN (SELECT * FROM fit WHERE k = 1) f ON parts.page_id = f.page_id"""


OP7_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, CAST(count(*) OVER (PARTITION BY s) AS BIGINT) AS group_size,
  row_number() OVER w = 1 AS kept, s AS text_sha256
FROM d WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id)"""


#: doc_id, the measurements and failed_bits of every document.
LEDGER_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS ws,
  [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
windows AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM s)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS k FROM windows) WHERE k > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(8)) AS k) GROUP BY doc_id),
m AS (SELECT s.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN ws]), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
  FROM s LEFT JOIN covered ON s.doc_id = covered.doc_id),
"""


def _ledger_sql() -> str:
    bits = " | ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(quality.RULES))
    return LEDGER_SQL + f"ledger AS (SELECT *, CAST({bits} AS BIGINT) AS failed_bits FROM m)"


def _op2_sql() -> str:
    return _ledger_sql() + f" SELECT *, failed_bits & {quality.BASE} <> 0 AS base_failed, failed_bits & {quality.POLICIES[quality.LATEST]} = 0 AS kept FROM ledger"


def _ablation_sql() -> str:
    rows = []
    for version, mask in sorted(quality.POLICIES.items()):
        for name, bit in quality.BIT.items():
            if bit & mask:
                count = lambda condition: f"CAST(count(*) FILTER ({condition}) AS BIGINT)"
                rows.append(f"SELECT CAST({version} AS INTEGER) AS policy, CAST(count(*) AS BIGINT) AS n_docs, {count(f'failed_bits & {mask} <> 0')} AS n_rejected, '{name}' AS rule, {count(f'failed_bits & {bit} <> 0')} AS n_failed, {count(f'failed_bits & {mask} = {bit}')} AS n_failed_alone FROM ledger")
    return _ledger_sql() + " " + " UNION ALL ".join(rows)


def _op6_sql() -> str:
    """The digests from the table itself, and the length of all windows from slots of tokens."""
    said = "\\### Assistant: </turn> ok"
    escaped = lambda c: f"replace(replace(replace({c}, '\\', '\\b'), '<turn', '\\lturn'), '</turn', '\\l/turn')"
    role = f"replace(replace({escaped('role')}, '>', '\\g'), chr(10), '\\n')"
    marks = len(chat.OPEN) + len(chat.END) + len(chat.CLOSE)
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{said}'), (-7, 1, 'assistant', '{said}')),
sized AS (SELECT *, strlen(text) AS b, strlen(regexp_replace(text, '[A-Za-z ]+', '', 'g')) AS rest,
  length({role}) + length({escaped('text')}) + {marks} AS size FROM c),
n AS (SELECT *, CAST(ceil((b - rest) / 4) AS BIGINT) + rest + {chat.OVERHEAD} AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM sized),
sys AS (SELECT *, pos = 1 AND role = 'system' AS system FROM n),
head AS (SELECT conv_id, coalesce(max(n) FILTER (system), 0) AS head FROM sys GROUP BY conv_id),
ends AS (SELECT sys.*, head, greatest(1, {chat.BUDGET - chat.HISTORY} - head) AS stride, CASE WHEN system THEN 0 ELSE n END AS fresh,
  sum(CASE WHEN system THEN 0 ELSE n END) OVER (PARTITION BY sys.conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto
  FROM sys JOIN head ON sys.conv_id = head.conv_id),
slots AS (SELECT *, CAST(floor(greatest(upto - 1, 0) / stride) AS BIGINT) AS slot FROM ends),
full_ AS (SELECT conv_id AS fc, slot AS fs, sum(fresh) AS slot_sum FROM slots GROUP BY 1, 2),
parts AS (SELECT slots.*, NOT (NOT system AND upto - n < slot * stride AND slot_sum > stride) AS part FROM slots JOIN full_ ON conv_id = fc AND slot = fs),
wins AS (SELECT conv_id AS wc, slot AS ws, part AS wp, row_number() OVER (PARTITION BY conv_id ORDER BY slot, part) AS window_, sum(fresh) AS window_sum, max(upto) AS window_end, max(head) AS h
  FROM parts GROUP BY 1, 2, 3),
room AS (SELECT *, lead(window_sum) OVER (PARTITION BY wc ORDER BY window_) AS next_sum, count(*) OVER (PARTITION BY wc) AS last_ FROM wins),
times AS (SELECT parts.*, CASE WHEN system THEN last_ WHEN next_sum IS NOT NULL AND window_end - upto + n <= least({chat.HISTORY}, {chat.BUDGET} - h - next_sum) THEN 2 ELSE 1 END AS times
  FROM parts JOIN room ON conv_id = wc AND slot = ws AND part = wp)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(size * times) AS BIGINT) AS formatted_chars
FROM times GROUP BY conv_id"""


def _op10_sql(templates: dict[str, str] = licenses.ALL_TEMPLATES, threshold: float = licenses.THRESHOLD) -> str:
    """Every segment's bigrams joined to the templates', with no pruning but the runs' places."""
    grams = ", ".join(f"('{name}', '{g}')" for name, t in sorted(templates.items()) for g in licenses.template_bigrams(t))
    places = ", ".join(f"('{mark}', {i}, {n})" for mark, p in licenses.places(templates, threshold).items() for i, n in p)
    words = lambda c: f"[x FOR x IN regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+') IF x <> '']"
    pairs = lambda ws: f"list_distinct(list_transform(range(1, len({ws})), lambda i: concat({ws}[i], ' ', {ws}[i + 1])))"
    up = (2 - threshold) / threshold
    return f"""
WITH grams(name, gram) AS (VALUES {grams}), sizes AS (SELECT name, count(*) AS b FROM grams GROUP BY name), places(mark, i, n) AS (VALUES {places}),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT doc_id, t, string_split(t, chr(10)) AS ls FROM d),
cut AS (SELECT doc_id, list_concat(ls, flatten([string_split(regexp_replace(x, '([.!?:])[ \\t]+', concat('\\1', chr(1)), 'g'), chr(1)) FOR x IN ls]), regexp_split_to_array(t, '\\n[ \\t\\r]*\\n'), [t]) AS ss FROM lines),
segs AS (SELECT doc_id, unnest(list_distinct(ss)) AS s FROM cut),
seg_sets AS (SELECT doc_id, 's' AS kind, row_number() OVER () AS k, {pairs('ws')} AS gs FROM (SELECT doc_id, {words('s')} AS ws FROM segs)),
w AS (SELECT doc_id, {words('t')} AS ws FROM d),
stood AS (SELECT doc_id, ws, unnest(range(1, len(ws))) AS p FROM w),
spans AS (SELECT DISTINCT doc_id, greatest(p - 1 - i, 0) AS start, n + least(p - 1 - i, 0) AS n FROM stood JOIN places ON mark = concat(ws[p], ' ', ws[p + 1])),
run_sets AS (SELECT doc_id, 'r' AS kind, row_number() OVER () AS k, {pairs('ws')} AS gs FROM (SELECT spans.doc_id, list_slice(ws, start + 1, start + n) AS ws FROM spans JOIN w ON spans.doc_id = w.doc_id)),
sets AS (SELECT * FROM seg_sets UNION ALL SELECT * FROM run_sets),
flat AS (SELECT doc_id, kind, k, len(gs) AS a, unnest(gs) AS gram FROM sets),
met AS (SELECT doc_id, kind, k, a, flat.gram, name FROM flat JOIN grams ON flat.gram = grams.gram),
scored AS (SELECT doc_id, kind, k, name, CAST(-2.0 AS DOUBLE) * count(*) / (a + b) AS minus FROM met JOIN sizes USING (name) WHERE a * CAST({up!r} AS DOUBLE) >= b AND a <= b * CAST({up!r} AS DOUBLE) GROUP BY doc_id, kind, k, name, a, b),
best AS (SELECT doc_id, kind, k, min(struct_pack(minus := minus, name := name)) AS m FROM scored GROUP BY doc_id, kind, k),
good AS (SELECT doc_id, kind, m.minus AS minus, m.name AS name FROM best WHERE m.minus <= {-threshold} + 1e-12),
runs AS (SELECT DISTINCT doc_id, minus, name FROM good r WHERE kind = 'r'
  AND NOT EXISTS (FROM good o WHERE o.doc_id = r.doc_id AND o.name = r.name AND (o.kind = 's' AND o.minus <= r.minus OR o.kind = 'r' AND o.minus < r.minus))),
found AS (SELECT doc_id, minus, name FROM good WHERE kind = 's' UNION ALL SELECT doc_id, minus, name FROM runs),
tops AS (SELECT doc_id, count(*) AS n, min(struct_pack(minus := minus, name := name)) AS m, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, m.name AS license, round(-m.minus, 6) AS dice, coalesce(names, '') AS licenses FROM d LEFT JOIN tops ON d.doc_id = tops.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": _op2_sql(), "op3_url_filter": _op3_sql(), "op6_chat_windows": _op6_sql(), "op7_exact_dedup": OP7_SQL, "op10_license_scan": _op10_sql(), "quality_ablation": _ablation_sql()}
