"""The queries of this folder: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._frames import table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train_on(docs, table(spark, sf_dir, "labels")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tokens

    return tokens.read_ids(tokens.write_ids(table(spark, sf_dir, "documents"), vocabulary()))


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pieces

    return pieces.encode_pieces(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import exact

    return exact.groups(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train_on(docs, table(spark, sf_dir, "labels")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    docs = table(spark, sf_dir, "documents")
    return secrets.secret_scan(docs, secrets.train_on(docs, table(spark, sf_dir, "labels")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack_pieces(table(spark, sf_dir, "documents"), vocabulary())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import rules

    out = rules.rules_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words_in=2)


def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary())


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import collocations

    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import alignment

    return alignment.align(table(spark, sf_dir, "documents"), vocabulary(), vocabulary("piece_bpe_32k.model"))


def license_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op2 what the contract fixes, for its SQL."""
    return op2_license_scan(spark, sf_dir).drop("labels", "score")


def secret_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op7 what the contract fixes, for its SQL."""
    return op7_secret_scan(spark, sf_dir).drop("spans")


def rule_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op9 what the contract fixes, for its SQL."""
    return op9_quality_rules(spark, sf_dir).drop("kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_license_scan": op2_license_scan,
    "op3_token_files": op3_token_files,
    "op4_sentence_pieces": op4_sentence_pieces,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_secret_scan": op7_secret_scan,
    "op8_packing": op8_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_bpe_round_trip": op11_bpe_round_trip,
    "op12_collocations": op12_collocations,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
    "license_base_columns": license_base_columns,
    "rule_base_columns": rule_base_columns,
    "secret_base_columns": secret_base_columns,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
               sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    # Sets of more than four fifths in common share one of the least fifth of either's elements, in any fixed order.
    "op10_near_duplicates": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: hash(w[i] || ' ' || w[i + 1]))) ELSE list_transform(w, lambda x: hash(x)) END AS s FROM w),
p AS (SELECT doc_id, unnest(list_sort(s)[1:CAST(len(s) - ceil(80 * len(s) / 100.0) + 1 AS INT)]) AS x FROM s),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id <> b.doc_id),
l AS (SELECT c.a, c.b FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b WHERE 180 * len(list_intersect(x.s, y.s)) >= 80 * (len(x.s) + len(y.s))),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = doc_id), doc_id)) AS component_id, doc_id <= coalesce((SELECT min(b) FROM r WHERE r.a = doc_id), doc_id) AS kept FROM s""",
    "op12_collocations": rf"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, s, unnest(list_transform(range(1, len(w) - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))) AS g FROM w, range(1, 6) t(s)),
f AS (SELECT lang, s, g, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING s = 1 OR count(*) >= 100),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE s = 1 GROUP BY 1),
c AS (SELECT lang, s, g, f AS a, string_split(g, ' ') AS w, unnest(range(1, s)) AS k FROM f WHERE s > 1),
x AS (SELECT c.lang, c.g, c.a, c.k, l.f AS l, r.f AS r, n.n, (1000 * c.a * n.n) // (l.f * r.f) AS score FROM c JOIN n ON n.lang = c.lang
    JOIN f l ON l.lang = c.lang AND l.g = array_to_string(c.w[1:c.k], ' ') JOIN f r ON r.lang = c.lang AND r.g = array_to_string(c.w[c.k + 1:c.s], ' ')),
b AS (SELECT lang, g, a, n, min({{'score': score, 'k': k, 'l': l, 'r': r}}) AS m FROM x GROUP BY ALL),
d AS (SELECT DISTINCT o.lang, array_to_string(string_split(o.g, ' ')[i:i + t - 1], ' ') AS g, o.f FROM f o, range(2, 5) q(t), range(1, 5) u(i) WHERE t < o.s AND i + t - 1 <= o.s),
e AS (SELECT lang, g, max(f) AS f FROM d GROUP BY ALL),
k AS (SELECT b.lang, b.g, b.a, b.n, b.m, row_number() OVER (PARTITION BY b.lang ORDER BY m.score DESC, a DESC, encode(b.g)) AS rank FROM b LEFT JOIN e ON e.lang = b.lang AND e.g = b.g WHERE e.f IS NULL OR e.f < b.a)
SELECT lang, rank, g AS phrase, a::BIGINT AS a, m.l::BIGINT AS l, m.r::BIGINT AS r, n::BIGINT AS n, m.score::BIGINT AS score FROM k WHERE rank <= 2000""",
    "license_base_columns": rf"""
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n_words, list_filter(range(0, len(w)), lambda i: w[i + 1] = 'under' AND w[i + 1:i + 4] = ['under', 'the', 'mit', 'license']) AS m, list_filter(range(0, len(w)), lambda i: w[i + 1] = 'apache' AND w[i + 1:i + 4] = ['apache', 'license', 'version', '2']) AS a,
    list_filter(range(0, len(w)), lambda i: w[i + 1] = 'cc' AND w[i + 1:i + 3] = ['cc', 'by', 'nc']) AS c FROM w)
SELECT doc_id, n_words, len(m) + len(a) + len(c) AS n_base, list_min(list_concat(m, a, c)) AS first_word, list_max(list_concat(m, a, c)) AS last_word,
    array_to_string(list_filter([CASE WHEN len(a) > 0 THEN 'apache-2' END, CASE WHEN len(c) > 0 THEN 'cc-by-nc' END, CASE WHEN len(m) > 0 THEN 'mit' END], lambda x: x IS NOT NULL), ',') AS base_labels FROM p""",
    # Where a match stands is what lies before it: the pieces between matches, and the matches.
    "secret_base_columns": r"""
        WITH p(kind, name, pattern) AS (VALUES (0, 'assign', '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'), (1, 'access', '(AKIA[A-Z0-9]{16,})'), (2, 'hex', '([0-9a-f]{24,})')),
d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
m AS (SELECT row, kind, name, regexp_extract_all(t, pattern) AS m, regexp_extract_all(t, pattern, 1) AS v, string_split_regex(t, pattern) AS b FROM d, p),
e AS (SELECT row, kind, name, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(v) AS v, unnest(b[1:len(m)]) AS b FROM m),
x AS (SELECT row, kind, name, v, sum(length(b) + length(m)) OVER (PARTITION BY row, kind ORDER BY i) AS e, length(m) AS n FROM e),
k AS (SELECT row, kind, name, CAST(e - n AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM x WHERE kind > 0 OR length(v) >= 6),
g AS (SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS l FROM k GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(l, '')) AS base_sha256 FROM d LEFT JOIN g USING (row)""",
    "rule_base_columns": r"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, t, w, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g, list_filter(string_split(t, chr(10)), lambda l: regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g') <> '') AS lines FROM w),
e AS (SELECT doc_id, unnest(g) AS g, unnest(range(1, len(g) + 1)) AS i FROM x),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM e),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(w) AS base_failed FROM x LEFT JOIN c USING (doc_id)""",
}
