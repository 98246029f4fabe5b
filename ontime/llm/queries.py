"""Queries of this package, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession

from ontime.llm import decontaminate, exact_dedup, filter_audit, merkle, mixing, quality, secret_scan, sentencepiece_fst, simhash, substring_dedup, suffix_dedup, toxicity, warc
from ontime.llm.common import materialise, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words_in().alias("words"))
    return mixing.mix(materialise(docs, "mix-words"), words="words").select("doc_id", "size", "source_size", "target", "taken")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("reasons")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = secret_scan.secret_scan(table(spark, sf_dir, "documents"))
    return secret_scan.report(findings)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url", "html")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))).drop("longest_match")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mixing": op2_mixing,
    "op3_quality": op3_quality,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_secret_scan": op8_secret_scan,
    "op9_warc": op9_warc,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_merkle": op11_merkle,
    "op12_filter_audit": op12_filter_audit,
    "op13_decontaminate": op13_decontaminate,
}

_WORD = r"[^\x20\x09-\x0D]+"

_EXACT = r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)"""

_MIXING = rf"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(rank - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
l AS (SELECT *, cap / weight AS ratio, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
v AS (SELECT arg_min(level, ratio) AS level FROM l WHERE ratio > level),
t AS (SELECT l.* EXCLUDE (level), least(cap, weight * v.level) AS target, CAST(floor(total / 16 + 0.5) AS BIGINT) AS blocks,
  greatest(1, CAST(ceil(source_size / 1000000) AS BIGINT), CAST(ceil(n_docs / 50000) AS BIGINT)) AS shards FROM l, v),
q AS (SELECT rank, blocks, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank) AS i FROM t, unnest(range(blocks)) u(k) WHERE target > 0),
c AS (SELECT t.*, coalesce(n, 0) AS source_blocks FROM t LEFT JOIN (SELECT rank, count(*) AS n FROM q WHERE i <= blocks GROUP BY rank) USING (rank)),
e AS (SELECT d.*, c.* EXCLUDE (source), CAST('0x' || substr(md5('1:shard:' || d.doc_id), 1, 15) AS BIGINT) % shards AS shard FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
h AS (SELECT rank, shard, any_value(source_blocks) AS source_blocks, sum(size)::DOUBLE AS shard_size, ceil(sum(size) / 16.0::DOUBLE) AS nb FROM e GROUP BY rank, shard),
z AS (SELECT rank, shard, source_blocks, row_number() OVER (PARTITION BY rank ORDER BY shard_size / (2 * k + 1) DESC, shard) AS i FROM h, unnest(range(source_blocks)) u(k) WHERE shard_size > 0),
y AS (SELECT h.*, least(coalesce(n, 0), nb * 2) AS quota FROM h LEFT JOIN (SELECT rank, shard, count(*) AS n FROM z WHERE i <= source_blocks GROUP BY ALL) USING (rank, shard)),
x AS (SELECT e.doc_id, e.size, e.source_size, e.target, y.nb, y.quota, CASE WHEN y.nb > 0 THEN floor(y.quota / y.nb) ELSE 0 END AS passes,
  sum(e.size) OVER (PARTITION BY e.rank, e.shard ORDER BY md5('1:' || e.doc_id), e.doc_id, e.size ROWS UNBOUNDED PRECEDING) - e.size AS start FROM e JOIN y USING (rank, shard))
SELECT doc_id, size, source_size, target, CAST(passes * size + least(size, greatest(0, (quota - passes * nb) * 16 - start)) AS BIGINT) AS taken FROM x"""



def _quality() -> str:
    """The same histograms, merged and shrunk in SQL."""
    measured = rf"""d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) u(i)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
e AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, unnest(range(3)) u(j) GROUP BY doc_id),
c AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(e.n, 0)::BIGINT AS n_repeat_words,
  length(t) - length(translate(t, '!?', '')) AS n_shouts, length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals, len(l) AS n_lines
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d) d LEFT JOIN e ON d.doc_id = e.doc_id),
m AS (SELECT *, {quality.BASE_FAILED} AS base_failed FROM c)"""
    rules, names, shrink = quality.RULES.items(), quality.fence_names(), 50
    rate = lambda a, b, by="": f"({a}{by})::DOUBLE / greatest({b}, 1)"
    dropped = lambda v: f"greatest(length(bin({v})) - {quality.BITS}, 0)"
    unit = f"{1 << quality.POINT}::DOUBLE"
    rates = ", ".join(f"{{'rate': '{name}', 'v': floor({rate(a, b)} * {unit})::BIGINT}}" for name, (a, b, *_) in rules)
    buckets, values, fences = [], [], []
    for name in names:
        side, of = name.split("_", 1)
        _, _, level, multiple, _ = quality.RULES[of]
        for part, p in (("start", round(100 * level) if side == "high" else 100 - round(100 * level)), ("mid", 50)):
            bucket = f"{part}_{name}"
            buckets.append(f"min(bucket) FILTER (rate = '{of}' AND below * 100 >= total * {p}) AS {bucket}")
            end = f"(CASE WHEN {bucket} = 0 THEN 0 ELSE {bucket} + (1::BIGINT << {dropped(bucket)}) END)" if (side == "high") == (part == "start") else bucket
            values.append(f"{end}::DOUBLE / {unit} AS {bucket}")
        spread = lambda t: f"({t}start_{name} - {t}mid_{name})" if side == "high" else f"({t}mid_{name} - {t}start_{name})"  # noqa: B023, E731
        fences.append(f"q.start_{name} {'+' if side == 'high' else '-'} {multiple}::DOUBLE * greatest({spread('q.')}, {spread('s.')})[wider] AS {name}")

    def ends(*by: str) -> str:
        by = "".join(f"{c}, " for c in by)
        return f"""(SELECT {by}n, {', '.join(values)} FROM (SELECT {by}max(total)::BIGINT AS n, {', '.join(buckets)} FROM (
  SELECT {by}rate, bucket, sum(n) OVER (PARTITION BY {by}rate ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY {by}rate) AS total
  FROM (SELECT {by}rate, bucket, sum(n)::BIGINT AS n FROM h GROUP BY ALL)) {'GROUP BY ' + by[:-2] if by else ''}))"""

    def own(*by: str) -> str:
        wider = "" if by else f" * ((q.n + {shrink}) / q.n)"
        return f"(SELECT q.* EXCLUDE ({', '.join(f'start_{x}, mid_{x}' for x in names)}), {', '.join(fences).replace('[wider]', wider)} FROM {ends(*by)} q, s)"

    mean = lambda below, above: ", ".join(f"({below}.n * {below}.{x} + {shrink} * {above}.{x}) / ({below}.n + {shrink}) AS {x}" for x in names)
    beyond = " OR ".join(
        [f"coalesce({rate(a, b, ' - 1')} > high_{name}, false)" for name, (a, b, *_) in rules]
        + [f"coalesce({rate(a, b, ' + 1')} < low_{name}, false)" for name, (a, b, _, _, both) in rules if both]
    )
    return f"""WITH {measured}, r6 AS (SELECT lang, source, unnest([{rates}], recursive := true) FROM m WHERE NOT base_failed),
h AS (SELECT lang, source, rate, (v >> {dropped('v')}) << {dropped('v')} AS bucket, count(*) AS n FROM r6 GROUP BY ALL),
s AS {ends()}, a AS {own()}, l AS (SELECT l.lang, l.n, {mean('l', 'a')} FROM {own('lang')} l, a),
f AS (SELECT o.lang, o.source, {mean('o', 'l')} FROM {own('lang', 'source')} o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({beyond}) AS kept
FROM m LEFT JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source"""


_SUBSTRINGS = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
p AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 12 <= len(w) THEN array_to_string(w[i:i + 12], ' ') END AS win FROM d, unnest(range(1, len(w) + 1)) u(i)),
f AS (SELECT win, min(doc_id) AS first FROM p WHERE win IS NOT NULL GROUP BY win),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i FROM p JOIN f USING (win) WHERE first < doc_id), unnest(range(13)) u(j)),
k AS (SELECT p.doc_id, count(*) AS kept, string_agg(p.word, ' ' ORDER BY p.i) AS text FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def _found(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    rx = pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, start, start + length(m[i]) AS stop FROM (
  SELECT doc_id, i, m, g, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM (
    SELECT doc_id, regexp_extract_all(t, '{rx}', 0) AS m, regexp_extract_all(t, '{rx}', {group}) AS g, string_split_regex(t, '{rx}') AS p FROM d),
  unnest(range(1, len(m) + 1)) u(i)) WHERE length(g[i]) >= {least}"""


_SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_found(i, kind, rx, group, least) for i, (kind, _, rx, group, least) in enumerate(secret_scan.RULES))}),
s AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (doc_id)"""

_WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT h, max(page_id) AS last FROM p GROUP BY h),
b AS (SELECT h, last, array_to_string(list_transform(string_split(sha1(h), ''), lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '') AS bits FROM g)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(bits, i * 5 + 1, 1)::INT + 8 * substr(bits, i * 5 + 2, 1)::INT + 4 * substr(bits, i * 5 + 3, 1)::INT + 2 * substr(bits, i * 5 + 4, 1)::INT + substr(bits, i * 5 + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM p JOIN b USING (h)"""



def _merkle(deep: int = 4) -> str:
    """Trees of up to 16^deep leaves, level by level: nodes, and per leaf the text of siblings and the folded digest."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    low = f"translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"  # noqa: F541
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    byte = "c"
    for _ in range(8):
        byte = f"(SELECT {step} FROM (SELECT {byte} AS c))" if byte != "c" else f"(SELECT {step} FROM (SELECT n AS c))"
    sql = [f"""crc AS (SELECT list({byte} ORDER BY n) AS t FROM range(256) r(n)),
ids AS (SELECT DISTINCT doc_id FROM documents),
hit AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295::BIGINT) % 5 = 0 AS hit FROM ids, crc),
l0 AS (SELECT d.doc_id, source, {leaf('text')} AS leaf, CASE WHEN hit THEN {leaf('low')} ELSE {leaf('text')} END AS seen
  FROM (SELECT *, {low} AS low FROM documents) d LEFT JOIN hit USING (doc_id)),
d0 AS (SELECT *, row_number() OVER w - 1 AS rank, leaf AS node, seen AS folded, '' AS proof FROM l0 WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf))"""]

    def climb(table: str, by: str, rank: str, n: int) -> str:
        """From nodes of a level (numbered by `rank`, as often as they have leaves) to the next."""
        name = f"{table[0]}{n + 1}"
        own = f"e{table[0]}{n}"
        sql.append(f"""u{name} AS (SELECT DISTINCT {by}, rank, node FROM {table}),
s{name} AS (SELECT {by}, rank // 16 AS up, list(node ORDER BY rank) AS kin, min(rank) AS first, any_value(many) AS many
  FROM (SELECT *, count(*) OVER (PARTITION BY {by}) > 1 AS many FROM u{name}) GROUP BY {by}, rank // 16),
{name} AS (SELECT x.* EXCLUDE (rank, node, folded, proof), CASE WHEN many THEN up ELSE 0 END AS rank,
  CASE WHEN many THEN sha256(array_to_string(kin, '')) ELSE node END AS node,
  CASE WHEN many THEN sha256(array_to_string(kin[1:rank - first], '') || folded || array_to_string(kin[rank - first + 2:], '')) ELSE folded END AS folded,
  CASE WHEN many THEN proof || array_to_string(kin[1:rank - first], '') || array_to_string(kin[rank - first + 2:], '') ELSE proof END AS proof
  FROM {table} x JOIN s{name} s ON x.rank // 16 = s.up AND {' AND '.join(f'x.{c} IS NOT DISTINCT FROM s.{c}' for c in by.split(', '))})""")
        return name

    last = "d0"
    for n in range(deep):
        last = climb(last, "source", "rank", n)
    sql.append(f"t0 AS (SELECT * EXCLUDE (rank), node AS subroot, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS rank, 0 AS one FROM {last})")
    last = "t0"
    for n in range(deep):
        last = climb(last, "one", "rank", n)
    return f"WITH {', '.join(sql)} SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = node AS verified FROM {last}"


def _audit() -> str:
    orders = ", ".join(f"'{''.join(p)}'" for p in permutations("ABCDE"))
    bits = "list_sum(list_transform(string_split(substr(o, 1, step{}), ''), lambda x: CASE x WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 4 WHEN 'D' THEN 8 WHEN 'E' THEN 16 ELSE 0 END))::INT"
    return rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
e AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t))::INT
  + 8 * (length(translate(t, '#$%&*|', '')) < length(t))::INT + 16 * (first < d.doc_id)::INT AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d JOIN e USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
s AS (SELECT o AS filter_order, step, substr(o, step, 1) AS f, coalesce({bits.format(' - 1')}, 0) AS before, {bits.format('')} - coalesce({bits.format(' - 1')}, 0) AS own
  FROM (SELECT unnest([{orders}]) AS o), range(1, 6) r(step)),
x AS (SELECT part, filter_order, CAST(step AS INT) AS step, f, CAST(sum(n) FILTER (mask & own = 0 AND mask & before = 0) AS BIGINT) AS kept, CAST(sum(n) FILTER (mask & own <> 0 AND mask & before = 0) AS BIGINT) AS removed,
  CAST(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0) AS BIGINT) AS redundant, CAST(sum(n) FILTER (mask = own) AS BIGINT) AS unique_fails,
  CAST(sum(good) FILTER (mask & own <> 0 AND mask & before = 0) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0) AS BIGINT) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, {', '.join(f'coalesce({k}, 0) AS {k}' for k in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))},
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley FROM x"""


_LEAKS = r"""WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(i) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT row, i, s.size, array_to_string(w[i:i + s.size - 1], ' ') AS win FROM d, unnest(range(1, len(w) + 1)) u(i), (SELECT DISTINCT size FROM g) s WHERE i + s.size - 1 <= len(w)),
f AS (SELECT row, i, p.size, item_id FROM p JOIN g ON p.size = g.size AND p.win = g.win),
h AS (SELECT row, count(DISTINCT i + j) AS n_hit FROM f, unnest(range(size)) u(j) GROUP BY row),
n AS (SELECT row, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS items FROM (SELECT DISTINCT row, item_id::VARCHAR AS name FROM f) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN n USING (row)"""

#: Columns of byte strings, learned scores, XXH64 and token
#: paths have no SQL form; the tests hold those queries against brute force.
ORACLE: dict[str, str] = {
    "op1_exact_dedup": _EXACT,
    "op2_mixing": _MIXING,
    "op3_quality": _quality(),
    "op5_substring_dedup": _SUBSTRINGS,
    "op8_secret_scan": _SECRETS,
    "op9_warc": _WARC,
    "op11_merkle": _merkle(),
    "op12_filter_audit": _audit(),
    "op13_decontaminate": _LEAKS,
}
