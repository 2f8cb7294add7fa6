"""Registered queries of the ten operators and the pipeline, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.catalog.registry import Query
from reportloom.llm.bpe import decode, encode
from reportloom.llm.common import UPPER, WORD, ascii_lower, crc_bucket
from reportloom.llm.embed_dedup import near_duplicate_vectors
from reportloom.llm.exact_dedup import exact_groups
from reportloom.llm.merkle import folded, leaf_digest, manifest, siblings
from reportloom.llm.mixing import mix
from reportloom.llm.ngram_join import near_duplicates
from reportloom.llm.packing import pack
from reportloom.llm.pii import KINDS, personal_data, written
from reportloom.llm.token_counts import over_limit, token_counts
from reportloom.llm.ppm import score_texts
from reportloom.llm.spelling import spelling_variants, without_letter, word_counts
from reportloom.llm.toxicity import toxicity
from reportloom.llm.url_filter import Rule, judge

#: SQL for the unsigned crc32 of a list of bytes; ``crc_table`` holds the 256 remainders of single bytes.
_CRC_TABLE_SQL = """
    crc_table AS (
        SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
                   lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _crc_sql(text: str) -> str:
    """crc32 of a text in UTF-8, beside ``crc_table``."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    step = "xor(t[(xor(c, b) & 255) + 1], c >> 8)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}), 4294967295::BIGINT)"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document by the mix of sources at weights 1, 2, 3; longer texts are likelier."""
    docs = table(spark, sf_dir, "documents")
    words = F.regexp_count(docs["text"], F.lit(WORD))
    found = mix(docs, tilt=F.log10(1 + words) / 5)
    each = found.withColumn("__row", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))))
    return each.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query(r"""
    WITH hashed AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
        FROM documents),
    groups AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM hashed GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
    FROM hashed JOIN groups USING (text_sha256)
""")
def op6_stateful_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with equal texts, from the state of a stream."""
    return exact_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256")
    )


@query()
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the byte-level vocabulary."""
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", over_limit(F.col("n_tokens")))


@query()
def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens along the Hilbert curve."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


#: The rules of the contract.
RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def _address_sql(url: str) -> str:
    rest = f"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    host = f"translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}')"
    return f"CASE WHEN {host} <> '' THEN {host} || CASE WHEN {rest} LIKE '/%' THEN {rest} ELSE '/' || {rest} END END"


_RULES_SQL = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)
_JUDGE_SQL = rf"""
    WITH RECURSIVE rules(verdict, rh, rp) AS (VALUES {_RULES_SQL}),
    seen AS (
        SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host,
               regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, {_address_sql("url")} AS address
        FROM pages),
    targets AS (
        SELECT url, regexp_extract(regexp_extract(html, '(?is)<link[^>]*rel\s*=\s*["'']?canonical[^>]*>'),
                                   '(?is)href\s*=\s*["'']?([^"''\s>]+)', 1) AS aim FROM pages
        UNION ALL
        SELECT url, regexp_extract(regexp_extract(html, '(?is)<meta[^>]*http-equiv\s*=\s*["'']?refresh[^>]*>'),
                                   '(?is)url\s*=\s*["'']?([^"''\s>]+)', 1) FROM pages),
    whole AS (
        SELECT url AS a, CASE WHEN contains(aim, '://') THEN aim WHEN aim LIKE '//%' THEN 'http:' || aim
                              WHEN aim LIKE '/%' THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || aim END AS b
        FROM targets WHERE aim <> '' AND url IS NOT NULL),
    links AS (SELECT a, b, {_address_sql("a")} AS u, {_address_sql("b")} AS v FROM whole WHERE b IS NOT NULL),
    edges AS (SELECT u, v FROM links WHERE u <> v UNION SELECT v, u FROM links WHERE u <> v),
    reach(node, other) AS (SELECT u, u FROM edges UNION SELECT r.node, e.v FROM reach r JOIN edges e ON r.other = e.u),
    ends AS (SELECT a AS url, u AS node FROM links UNION SELECT b, v FROM links),
    told AS (
        SELECT e.node, arg_max(r.verdict, length(r.rh || r.rp) * 2 + (r.verdict = 'allow')::INT) AS verdict
        FROM ends e JOIN rules r
          ON ('.' || translate(regexp_extract(e.url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}')) LIKE ('%.' || r.rh)
         AND starts_with(regexp_extract(e.url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), r.rp)
        GROUP BY e.node, e.url),
    passed AS (SELECT r.node, min(t.verdict) AS verdict FROM reach r JOIN told t ON t.node = r.other GROUP BY r.node),
    own AS (
        SELECT s.page_id, arg_max(r.rh || r.rp, length(r.rh || r.rp) * 2 + (r.verdict = 'allow')::INT) AS rule,
               arg_max(r.verdict, length(r.rh || r.rp) * 2 + (r.verdict = 'allow')::INT) AS verdict
        FROM seen s JOIN rules r ON ('.' || s.host) LIKE ('%.' || r.rh) AND starts_with(s.path, r.rp) GROUP BY s.page_id)
    SELECT s.page_id, s.host, s.path, o.rule, coalesce(o.verdict, p.verdict, 'allow') AS verdict,
           o.verdict IS NULL AND p.verdict IS NOT NULL AS passed_on
    FROM seen s LEFT JOIN own o USING (page_id) LEFT JOIN passed p ON p.node = s.address
"""


@query(_JUDGE_SQL)
def op2_redirect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page by the rules and the components of redirects and canonical links."""
    return judge(table(spark, sf_dir, "pages"), RULES)


@query()
def op3_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, by the fixed patterns and by boosted candidates."""
    found = personal_data(table(spark, sf_dir, "documents"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(number, KINDS), F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.concat("base", "added")).alias("spans"),
    )


@query()
def op5_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by the conditional random field, with the places of the words tagged toxic."""
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= 0.7).cast("int")
    return scored.select("doc_id", "held_out", "score", predicted.alias("predicted"), "spans")


@query(rf"""
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x20\x09-\x0D]+'),
                                   lambda w: w <> '') AS w FROM documents),
    sets AS (
        SELECT doc_id, list_distinct(CASE
            WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
    tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
    shared AS (
        SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m
        FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT u, v FROM shared WHERE 100 * c >= 75 * (n + m - c)),
    reach(node, other) AS (SELECT u, u FROM links UNION SELECT r.node, l.v FROM reach r JOIN links l ON r.other = l.u),
    least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
    equal AS (SELECT u, min(v) AS v FROM shared WHERE c = n AND c = m GROUP BY u)
    SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id,
           least(s.doc_id, coalesce(e.v, s.doc_id)) AS class_id
    FROM sets s LEFT JOIN least l ON l.node = s.doc_id LEFT JOIN equal e ON e.u = s.doc_id
""")
def op8_combination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share three quarters of their five-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op9_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the byte model and by word counts."""
    return score_texts(table(spark, sf_dir, "documents"), whole_bytes=True)


@query("""
    WITH RECURSIVE usable AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (
        SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b
          ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.98),
    reach(node, other) AS (SELECT u, u FROM links UNION SELECT r.node, l.v FROM reach r JOIN links l ON r.other = l.u),
    least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
    counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
    SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
           vec_id = coalesce(component_id, vec_id) AS kept
    FROM embeddings LEFT JOIN least ON node = vec_id LEFT JOIN counts ON u = vec_id
""")
def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings with a cosine of at least 0.98."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


#: Levels of the trees in SQL, enough for 16**6 documents a source and as many sources.
_LEVELS = 6


def _tree_sql(tree: str, leaves: str) -> str:
    """CTEs of a tree's levels over ``leaves`` (g, idx, digest): what stands around each node of a run, and the level above."""
    parts = [f"{tree}0 AS (SELECT g, idx, digest, count(*) OVER (PARTITION BY g) AS n FROM {leaves})"]
    for k in range(_LEVELS):
        over = "OVER (PARTITION BY g, idx // 16 ORDER BY idx ROWS BETWEEN"
        parts.append(
            f"""{tree}_around{k} AS (
        SELECT g, idx, n > 1 AS hashed,
               coalesce(string_agg(digest, '') {over} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
               coalesce(string_agg(digest, '') {over} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
        FROM {tree}{k})"""
        )
        parts.append(
            f"""{tree}{k + 1} AS (
        SELECT g, idx // 16 AS idx, CASE WHEN n = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY idx)) END AS digest,
               (n + 15) // 16 AS n
        FROM {tree}{k} GROUP BY g, idx // 16, n)"""
        )
    return ",\n    ".join(parts)


def _fold_sql(rows: str, tree: str, k: int) -> str:
    """Rows (g, idx, f, proof, ...) one level up the tree."""
    return f"""{rows}{k + 1} AS (
        SELECT r.* REPLACE (r.idx // 16 AS idx, CASE WHEN a.hashed THEN sha256(a.before || r.f || a.after) ELSE r.f END AS f,
                            r.proof || a.before || a.after AS proof)
        FROM {rows}{k} r JOIN {tree}_around{k} a ON r.g IS NOT DISTINCT FROM a.g AND r.idx = a.idx)"""


def _written_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


_LEAF_SQL = "sha256(" + " || ".join(map(_written_sql, ["doc_id", "source", "lang", "n_chars", "{text}"])) + ")"


@query(f"""
    WITH {_CRC_TABLE_SQL},
    docs AS (
        SELECT doc_id, source AS g, {_LEAF_SQL.format(text="text")} AS leaf,
               {_LEAF_SQL.format(text=f"translate(text, '{UPPER}', '{UPPER.lower()}')")} AS changed,
               coalesce({_crc_sql("doc_id::VARCHAR")} % 5 = 0, false) AS tampered
        FROM documents, crc_table),
    placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM docs),
    leaves AS (SELECT g, idx, leaf AS digest FROM placed),
    {_tree_sql("own", "leaves")},
    subroots AS (SELECT 0 AS g, g AS source, row_number() OVER (ORDER BY g IS NOT NULL, encode(g)) - 1 AS idx, digest FROM own{_LEVELS}),
    {_tree_sql("top", "subroots")},
    up0 AS (SELECT doc_id, leaf, g, idx, CASE WHEN tampered THEN changed ELSE leaf END AS f, '' AS proof FROM placed),
    {", ".join(_fold_sql("up", "own", k) for k in range(_LEVELS))},
    across0 AS (
        SELECT u.doc_id, u.leaf, s.digest AS subroot, 0 AS g, s.idx, u.f, u.proof
        FROM up{_LEVELS} u JOIN subroots s ON u.g IS NOT DISTINCT FROM s.source),
    {", ".join(_fold_sql("across", "top", k) for k in range(_LEVELS))}
    SELECT a.doc_id, a.leaf, a.subroot, t.digest AS root, sha256(a.proof) AS proof_sha256, a.f AS folded_root, a.f = t.digest AS verified
    FROM across{_LEVELS} a, top{_LEVELS} t
""")
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, folded again from the leaves of tampered ones."""
    docs = table(spark, sf_dir, "documents")
    columns = [docs[c] for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = docs["doc_id"].isNotNull() & (crc_bucket(docs["doc_id"], 5) == 0)
    proofs = manifest(docs, carried={"changed": F.when(tampered, leaf_digest([*columns, ascii_lower(docs["text"])]))})
    root = folded(F.coalesce("changed", "leaf"), F.col("proof"))
    found = proofs.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root",
        F.sha2(F.array_join(siblings(F.col("proof")), ""), 256).alias("proof_sha256"), root.alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


@query(f"""
    WITH RECURSIVE {_CRC_TABLE_SQL},
    runs AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[A-Za-zÀ-ÿ]+')) AS run
        FROM documents),
    met AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 5 GROUP BY ALL),
    hashed AS (SELECT run, c, {_crc_sql("doc_id::VARCHAR || ':' || run")} AS h FROM met, crc_table),
    changed AS (
        SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c
        FROM hashed),
    words AS (SELECT word, sum(c)::BIGINT AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
    places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
    cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM places),
    near AS (
        SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
        UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
    best AS (
        SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS k
        FROM near),
    formed AS (
        SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 2 * w.n THEN b.other END AS form,
               CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n
        FROM words w LEFT JOIN best b ON b.word = w.word AND b.k = 1),
    chain(word, last) AS (
        SELECT word, word FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.last WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, c.last AS root, f.n, f.n_near, f.form_n
    FROM formed f JOIN chain c ON c.word = f.word JOIN formed e ON e.word = c.last AND e.form IS NULL
""")
def op12_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all words, some of whose occurrences lose a letter."""

    def change(doc_id: Column, run: Column) -> Column:
        h = F.crc32(F.concat(doc_id, F.lit(":"), run).cast("binary"))
        return F.when(h % 97 == 0, without_letter(run, h % F.char_length(run))).otherwise(run)

    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), change))


@query()
def op11_pair_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the byte-level vocabulary, and the text they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "ids",
    )
    return decode(ids, path, text_col="decoded").select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )
