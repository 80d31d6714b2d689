"""The registered opN_ queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    """The public word-level BPE vocabulary the packing contract names."""
    return importlib.import_module("public_tokenizers").path("word_bpe_49k.json")


@_query
def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_documents
    return score_documents(_read(spark, sf_dir, "documents"))


@_query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates
    found = near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@_query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import report
    return report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=10).drop("hits", "items")


@_query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    return pack(_read(spark, sf_dir, "documents"), tokenizer_path(), window=2048)


@_query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines
    kept = dedup_lines(_read(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


# --- oracle SQL (DuckDB); the other operators are tested against brute force ---

_WS = r"[\x20\x09-\x0D]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_KEY = _LOW.format(r"regexp_replace(regexp_replace({}, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')")

ORACLE: dict[str, str] = {}

ORACLE["op10_line_dedup"] = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, line, pos, {_KEY.format('line')} AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
g AS (SELECT k.doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.key IS NULL), '') AS kept
      FROM k LEFT JOIN hot USING (key) GROUP BY k.doc_id)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM g"""

ORACLE["op2_line_frequency"] = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
        string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
tri AS (SELECT doc_id, unnest(generate_series(1, len(w) - 2)) AS i, w FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, i, w[i:i + 2] AS gram FROM tri),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
l AS (SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, source, line, pos, {_KEY.format('line')} AS key,
        len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS nw FROM l),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM k WHERE nw > 0 GROUP BY doc_id),
hot AS (SELECT k.source, k.key FROM k JOIN d USING (doc_id) WHERE length(k.key) > 0
        GROUP BY k.source, k.key HAVING count(DISTINCT d.t) >= 10),
gone AS (SELECT k.doc_id, count(*) AS nl, sum(nw) AS nw FROM k JOIN hot ON k.key = hot.key AND k.source IS NOT DISTINCT FROM hot.source
        GROUP BY k.doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
        coalesce(dl.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
        coalesce(gone.nl, 0) AS n_removed_lines, CAST(coalesce(gone.nw, 0) AS BIGINT) AS n_removed_words
      FROM d LEFT JOIN dl USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_removed_lines, n_removed_words,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * (n_words - n_removed_words) >= n_words AS kept
FROM m"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLE["op6_decontaminate"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS n, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS i, w FROM d),
occ AS (SELECT dw.doc_id, dw.i, s.n, win.item_id FROM dw CROSS JOIN sizes s
        JOIN win ON win.n = s.n AND win.g = array_to_string(dw.w[dw.i:dw.i + s.n - 1], ' ') WHERE dw.i + s.n - 1 <= len(dw.w)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS h
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items,
  coalesce(it.h, sha256('')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""


@_query
def op1_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats
    return remove_repeats(_read(spark, sf_dir, "documents"), window=13).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE["op1_recompression"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(generate_series(1, len(w) - 12)) AS i, w FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM p),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM g),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM f WHERE m < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT x.doc_id, coalesce(string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE c.i IS NULL), '') AS kept, count(c.i) AS n
      FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""


@_query
def op3_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_texts
    return score_texts(_read(spark, sf_dir, "documents"), folds=7, held=2)


@_query
def op7_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import main_texts
    return main_texts(_read(spark, sf_dir, "pages"))


@_query
def op9_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify
    return identify(_read(spark, sf_dir, "documents"), folds=4, held=2)


@_query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import find_licenses
    return find_licenses(_read(spark, sf_dir, "documents"))


@_query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = manifest(_read(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"],
                     tampered=(changed, "text"))
    return found.select("doc_id", "leaf", "subroot", "root",
                        F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), "folded_root", "verified")


def _crc32_sql(text: str) -> str:
    """CRC-32 of a short ASCII text, bit by bit, as DuckDB has no function for it."""
    step = "list_reduce(list_prepend(xor({c}, {b}), range(8)), lambda v, i: CASE WHEN v & 1 = 1 " \
           "THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: {step.format(c='c', b='b')}), 4294967295)"


def _merkle_levels(name: str, levels: int, part: str) -> str:
    """CTEs name_0..name_levels: nodes (part, idx, n, h, run, place) of each level over name_src (part, idx, h)."""
    out, src = [], f"{name}_src"
    for k in range(levels + 1):
        h = f"""SELECT {part}, idx, h, count(*) OVER (PARTITION BY {part}) AS n FROM {src}"""
        out.append(f"""{name}_{k} AS (SELECT {part}, idx, n, h, idx % 16 AS place,
          string_agg(h, '') OVER (PARTITION BY {part}, idx // 16 ORDER BY idx
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run FROM ({h}))""")
        out.append(f"""{name}_up{k} AS (SELECT {part}, idx // 16 AS idx, CASE WHEN any_value(n) = 1 THEN any_value(h)
          ELSE sha256(any_value(run)) END AS h FROM {name}_{k} GROUP BY {part}, idx // 16)""")
        src = f"{name}_up{k}"
    return ",\n".join(out)


def _merkle_sql(low: int = 5, top: int = 3) -> str:
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen(CAST({0} AS VARCHAR)), ':', {0}) END"

    def leaf(text: str) -> str:
        return "sha256(concat(" + ", ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"

    steps = [("low", k) for k in range(low)] + [("top", k) for k in range(top)]
    joins, proof, folds, cur = [], [], [], "now"
    for name, k in steps:
        a, at = f"{name}{k}", "idx" if name == "low" else "sidx"
        joins.append(f"JOIN {name}_{k} {a} ON {a}.idx = x.{at} // {16 ** k} AND "
                     + (f"{a}.source IS NOT DISTINCT FROM x.source" if name == "low" else f"{a}.all_ = 1"))
        others = f"concat(substr({a}.run, 1, 64 * {a}.place), substr({a}.run, 64 * {a}.place + 65))"
        proof.append(f"CASE WHEN {a}.n > 1 THEN {others} ELSE '' END")
        folds.append(f"{a}.n AS n_{a}, substr({a}.run, 1, 64 * {a}.place) AS l_{a}, substr({a}.run, 64 * {a}.place + 65) AS r_{a}")
    chain, prev = [], "p"
    for name, k in steps:
        a = f"{name}{k}"
        chain.append(f"f_{a} AS (SELECT * REPLACE (CASE WHEN n_{a} > 1 THEN sha256(concat(l_{a}, now, r_{a})) ELSE now END AS now) FROM {prev})")
        prev = f"f_{a}"
    return f"""WITH low_src AS (SELECT doc_id, source, {leaf('text')} AS h,
   CASE WHEN {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {leaf(_LOW.format('text'))} END AS changed,
   row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS idx FROM documents),
{_merkle_levels('low', low, 'source')},
top_src AS (SELECT 1 AS all_, source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx FROM low_up{low}),
{_merkle_levels('top', top, 'all_')},
x AS (SELECT d.doc_id, d.source, d.idx, d.h AS leaf, coalesce(d.changed, d.h) AS now, t.idx AS sidx, t.h AS subroot,
   (SELECT h FROM top_up{top}) AS root FROM low_src d JOIN top_src t ON t.source IS NOT DISTINCT FROM d.source),
p AS (SELECT x.*, sha256(concat({', '.join(proof)})) AS proof_sha256, {', '.join(folds)} FROM x {' '.join(joins)}),
{', '.join(chain)}
SELECT doc_id, leaf, subroot, root, proof_sha256, now AS folded_root, now = root AS verified FROM {prev}"""


ORACLE["op12_merkle_manifest"] = _merkle_sql()


@_query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turn_trie import rebuilt, trie_nodes
    return trie_nodes(rebuilt(_read(spark, sf_dir, "conversations"), family=100, heads=6))


ORACLE["op13_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i,
        coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base,
        {_crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM t),
r AS (SELECT c.conv_id, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
      UNION ALL SELECT c.conv_id, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d FROM r),
p AS (SELECT conv_id, d, length(text) AS n,
        md5(string_agg(concat(strlen(role), ':', strlen(text), ':', role, text), '') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM q
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
m AS (SELECT *, max(d) OVER (PARTITION BY conv_id) AS len, min(conv_id) OVER (PARTITION BY d, k) AS node,
        lag(k) OVER (PARTITION BY conv_id ORDER BY d) AS up FROM p),
v AS (SELECT d, k, min(node) AS conv_id, count(*) AS n_convs, any_value(n) AS n, any_value(up) AS up,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len = d), '')) AS ends_sha256
      FROM m GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM v WHERE d > 0 GROUP BY ALL),
w AS (SELECT v.*, coalesce(kids.n, 0) AS n_children FROM v LEFT JOIN kids USING (d, k)),
below AS (SELECT a.d, a.k, sum((w.n_convs - 1) * w.n) AS saved, count(*) FILTER (WHERE w.n_children = 0) AS leaves
          FROM w JOIN m a ON a.conv_id = w.conv_id AND a.d <= w.d GROUP BY a.d, a.k)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, x.conv_id AS parent_conv_id, w.n_convs, w.n_children,
  below.leaves AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN below USING (d, k) LEFT JOIN v x ON x.d = w.d - 1 AND x.k = w.up"""


@_query
def op11_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates
    return near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, percent=85)


ORACLE["op11_circulant_minhash"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT reach.u, e.v FROM reach JOIN e ON e.u = reach.v),
m AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""
