"""The queries opN_<name> over whole tables, with production parameters, and the SQL for those that SQL can express."""

from __future__ import annotations

import os
import secrets
import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bytewindows, lines, merkle, middle, minhash, mixing, pii, quality, rules, tokencounts, topk, urls
from .common import table

#: The ranks of the contract.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TOKEN_LIMIT = 2048


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: sources weigh 1, 2, 3 in turn, and at most three passes are made over one."""
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most_passes=3, seed=17)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its entities replaced. The key is SURROGATE_KEY, which a secret store would set; without it, a new
    one that nobody knows, so that surrogates differ from run to run."""
    rewritten = pii.replaced(table(spark, sf_dir, "documents"), key=os.environ.get("SURROGATE_KEY") or secrets.token_hex(32))
    return rewritten.select("doc_id", F.col("_entities").alias("n_entities"), "text")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less its maximal repeated line runs: counts, and a digest of what is left."""
    cut = lines.deduplicated(table(spark, sf_dir, "documents"))
    counts = [F.col(f"_{c}").cast("long").alias(f"n_{c}") for c in ("lines", "removed", "runs", "longest")]
    return cut.select("doc_id", *counts, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def _op3_sql() -> str:
    """The same by brute force: all pairs of equal lines, and the runs of them in which both places go on line by line."""
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS al FROM documents),
    u AS (SELECT doc_id, no, al[no] AS x, len(regexp_extract_all(al[no], '[^\x20\x09-\x0D]+')) AS n FROM (SELECT doc_id, al, unnest(range(1, len(al) + 1)) AS no FROM d)),
    l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS i FROM u WHERE n > 0),
    p AS (SELECT b.doc_id, b.i, b.no, b.n, a.doc_id AS other, b.i - a.i AS shift FROM l b JOIN l a ON a.x = b.x AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.i < b.i))),
    k AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY i) AS island FROM p),
    r AS (SELECT doc_id, min(no) AS a, max(no) AS b, sum(n) AS words, count(*) AS size FROM k GROUP BY doc_id, other, shift, island),
    m AS (SELECT doc_id, max(size) AS size FROM r GROUP BY doc_id),
    c AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS no FROM r WHERE words >= {lines.MIN_WORDS}),
    g AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (no <> coalesce(before, -1) + 1) AS n_runs, list(no) AS gone FROM (SELECT *, lag(no) OVER (PARTITION BY doc_id ORDER BY no) AS before FROM c) GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE CAST(len(al) AS BIGINT) END AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, coalesce(1::BIGINT << CAST(floor(log2(m.size)) AS BIGINT), 0) AS n_longest,
        sha256(CASE WHEN gone IS NULL THEN t ELSE array_to_string(list_transform(list_filter(range(1, len(al) + 1), lambda k: NOT list_contains(gone, k)), lambda k: al[k]), chr(10)) END) AS kept_sha256
    FROM d JOIN documents USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN m USING (doc_id)
    """


def op4_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate group at a similarity of 0.85."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op5_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's own evidence, the priors of its site, and whether it is kept."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, and else by the regression."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document with the rank file and decodes the ids again; digests of both."""
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest others of every 50th vector by integer inner product."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


def _op8_sql() -> str:
    """All queries against all others."""
    return """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
    SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p) WHERE rank <= 5
    """


def op9_byte_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less the bytes under 50-byte windows of documents with smaller ids; a digest of what is left."""
    cut = bytewindows.repeated_windows(table(spark, sf_dir, "documents"), window=50)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and adaptive limits over all documents."""
    judged = rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op10_sql() -> str:
    """The base counts by brute force over windows, and the limits by sorting each group's bins."""
    edge = "(({0} >> greatest(length(bin({0})) - 6, 0)) << greatest(length(bin({0})) - 6, 0))"
    bins = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {edge.format(m)} AS edge, {f} AS floor FROM m WHERE NOT base_failed" for m, f in rules.MEASURES.items())

    def level(keys: str) -> str:
        by = f"{keys}, " if keys else ""
        return f"""SELECT {by}measure, max(floor) AS floor, count(*) AS docs, list_sort(list(edge))[CAST(ceil(count(*) / 4.0) AS BIGINT)] AS q1,
            list_sort(list(edge))[CAST(ceil(3 * count(*) / 4.0) AS BIGINT)] AS q3 FROM bins GROUP BY {by}measure"""

    n = rules.LEAST_DOCS
    pick = lambda q: f"CASE WHEN o.docs >= {n} THEN o.{q} WHEN l.docs >= {n} THEN l.{q} ELSE e.{q} END"
    values = "CASE measure " + " ".join(f"WHEN '{m}' THEN m.{m}" for m in rules.MEASURES) + " END"
    both = ", ".join(f"'{m}'" for m in rules.BOTH_SIDES)
    return rf"""
    WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
    r AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
    c AS (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines FROM w LEFT JOIN r USING (doc_id)),
    m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 1000 * n_symbols // greatest(word_chars, 1) AS symbol_permille, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_permille,
        1000 * n_repeat_words // greatest(n_words, 1) AS repeat_permille, 100 * word_chars // greatest(n_words, 1) AS word_length_percent FROM c),
    bins AS ({bins}), own AS ({level("lang, source")}), lng AS ({level("lang")}), every AS ({level("")}),
    lim AS (SELECT o.lang, o.source, o.measure, o.floor, {pick("q1")} AS q1, {pick("q3")} AS q3 FROM own o JOIN lng l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN every e ON o.measure = e.measure),
    bad AS (SELECT DISTINCT m.doc_id FROM m JOIN lim ON m.lang IS NOT DISTINCT FROM lim.lang AND m.source IS NOT DISTINCT FROM lim.source
        WHERE {values} > q3 + greatest({rules.FENCE} * (q3 - q1), floor) OR (measure IN ({both}) AND {values} < q1 - greatest({rules.FENCE} * (q3 - q1), floor)))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m
    """


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, and whether they are more than a context of 2,048 holds."""
    counted = tokencounts.count_tokens(table(spark, sf_dir, "documents"), WORD_VOCABULARY)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a manifest by language, its proof, and whether a copy, tampered with in a third of the rows, still fits."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), changed={"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)}, where=tampered)


def _op12_sql(deep: int = 9, top: int = 4) -> str:
    """The same level by level, for up to 8^deep documents of a language and 8^top languages."""

    def tree(n: str, levels: int) -> str:
        """Tables n1, n2, ... above n0 (t, p, d, n), with each node's siblings to the left and right."""
        out = []
        for k in range(levels):
            run = "string_agg(d, '') OVER (PARTITION BY t, p // 8 ORDER BY p ROWS BETWEEN {} AND {})"
            out.append(f"{n}s{k} AS (SELECT *, coalesce({run.format('UNBOUNDED PRECEDING', '1 PRECEDING')}, '') AS l, coalesce({run.format('1 FOLLOWING', 'UNBOUNDED FOLLOWING')}, '') AS r FROM {n}{k})")
            out.append(f"{n}{k + 1} AS (SELECT t, p // 8 AS p, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY p)) ELSE any_value(d) END AS d, (n + 7) // 8 AS n FROM {n}{k} GROUP BY t, p // 8, n)")
        return ", ".join(out)

    def fold(begin: str, name: str, n: str, levels: int) -> str:
        """name: the rows of begin (t, p, f, proof, ...) with f folded to the top of the tree, and proof longer by its siblings."""
        out = [f"{name}0 AS (SELECT * FROM {begin})"]
        for k in range(levels):
            step = "CASE WHEN s.n > 1 THEN sha256(s.l || x.f || s.r) ELSE x.f END AS f, x.proof || s.l || s.r AS proof"
            out.append(f"{name}{k + 1} AS (SELECT x.* REPLACE ({step}) FROM {name}{k} x JOIN {n}s{k} s ON x.t = s.t AND x.p // {8**k} = s.p)")
        return ", ".join(out)

    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    crc = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda c, i: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))))"""
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""
    WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS t, {leaf("text")} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS claimed FROM documents),
    o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY t) AS n FROM d),
    a0 AS (SELECT t, p, leaf AS d, n FROM o), {tree("a", deep)},
    u AS (SELECT t AS name, d, row_number() OVER (ORDER BY encode(t)) - 1 AS p, count(*) OVER () AS n FROM a{deep}),
    b0 AS (SELECT '' AS t, p, d, n FROM u), {tree("b", top)},
    {fold("(SELECT doc_id, t, p, leaf, claimed AS f, '' AS proof FROM o)", "x", "a", deep)},
    {fold(f"(SELECT x.* REPLACE ('' AS t, u.p AS p), u.d AS subroot FROM x{deep} x JOIN u ON x.t = u.name)", "y", "b", top)}
    SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = d AS verified FROM y{top}, b{top}
    """


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document arranged for filling in its middle lines: form, cuts, and digests of the output and of the text made from it again."""
    return middle.transformed(table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50, texts=False)


def _op13_sql() -> str:
    """The same with lists of lines."""
    draw = lambda k: f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)"
    join = lambda span: f"array_to_string(u[{span}], '')"
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, {draw(0)} % (len(u) + 1) AS x, {draw(1)} % (len(u) + 1) AS y,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {draw(2)} % 100 >= 100 THEN 'plain' WHEN {draw(3)} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
    p AS (SELECT *, {join("1:least(x, y)")} AS a, {join("least(x, y) + 1:greatest(x, y)")} AS b, {join("greatest(x, y) + 1:n")} AS e FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || e || '<M>' || b ELSE '<S>' || e || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
    """


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_line_dedup": op3_line_dedup,
    "op4_minhash_near_dups": op4_minhash_near_dups,
    "op5_quality_bayes": op5_quality_bayes,
    "op6_url_filter": op6_url_filter,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_byte_windows": op9_byte_windows,
    "op10_quality_rules": op10_quality_rules,
    "op11_token_counts": op11_token_counts,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES = {"op3_line_dedup": _op3_sql(), "op8_exact_top_k": _op8_sql(), "op10_quality_rules": _op10_sql(), "op12_merkle_manifest": _op12_sql(), "op13_fill_in_middle": _op13_sql()}
