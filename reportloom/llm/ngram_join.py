"""Near duplicates by word shingles: prefixes of tokens and token pairs find the candidates, whole texts decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.llm.common import bounded, components, finished, give_back, memory_for, remembers, ship_code, staged

#: Words in a shingle; the similarity as a fraction.
WORDS, OVER, UNDER = 5, 75, 100
#: A hash-ordered prefix is extended by 2 + n // STRETCH tokens.
STRETCH = 16
#: Documents that may hold a token for it to count as rare.
RARE = 16
#: Rows (of one or two long numbers) up to which lists of documents are broadcast.
BROADCAST_IDS = 1_000_000
#: Bits of the fixed-size map that keeps most unshared tokens out of the shuffles (16 MB), in words of 32 bits.
MAP_BITS, MAP_WORD = 27, 5
#: Words a worker remembers the hashes of.
REMEMBERED = 200_000

_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_hashes = WordHashes()
remembers("ngram_join", _hashes.clear)


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    A-Z are lower-cased, words stand between ASCII white space; fewer than ``words`` words are one shingle, none are none.
    """
    split = text.encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.zeros(0, np.int64)
    hashed = np.fromiter(map(_hashes.__getitem__, split), np.uint64, len(split))
    run = min(words, len(hashed))
    count = len(hashed) - run + 1
    mixed = np.full(count, run, np.uint64) * _SEEDS[0]
    for k in range(run):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _SEEDS[1] + hashed[k : k + count]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _SEEDS[0]
    return np.unique((mixed ^ (mixed >> np.uint64(29))).view(np.int64))


def needed(n: int) -> int:
    """The least overlap that a set of ``n`` has with any set it links with."""
    return -(-n * OVER // UNDER)


def prefix_length(n: int) -> int:
    """Linked sets share at least ``extension`` (of the smaller one) tokens within their first so many."""
    return min(n, n - needed(n) + 2 + n // STRETCH)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return UNDER * common >= OVER * (len(a) + len(b) - common) and common > 0


def _prefixes(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    memory_for("ngram_join")
    for batch in batches:
        sets = [shingle_set(text, words) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([s[: prefix_length(len(s))] for s in sets], pa.list_(pa.int64())),
            ],
            names=["doc_id", "n", "set_hash", "prefix"],
        )


def _whole_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    memory_for("ngram_join")
    for batch in batches:
        sets = [shingle_set(text, words) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
            names=["d", "n", "tokens"],
        )


def _verify(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    memory_for("ngram_join")
    for batch in batches:
        last, own, hits = None, np.zeros(0, np.int64), []
        for left, right in zip(*(batch.column(c).to_pylist() for c in ("left_text", "right_text")), strict=True):
            if left != last:
                last, own = left, shingle_set(left, words)
            hits.append(linked(own, shingle_set(right, words)))
        kept = pa.table({"u": batch.column("a"), "v": batch.column("b")}).filter(pa.array(hits, pa.bool_()))
        yield from kept.to_batches()


def verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Of candidate pairs (``a``, ``b``) those whose whole texts link, as (``u``, ``v``), staged.

    Only documents that some pair names are moved.
    """
    ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "join-ids")
    named = texts.join(bounded(ids, BROADCAST_IDS), "doc_id", "left_semi")
    both = pairs.join(named.select(F.col("doc_id").alias("a"), F.col("text").alias("left_text")), "a").join(
        named.select(F.col("doc_id").alias("b"), F.col("text").alias("right_text")), "b"
    )
    kinds = pairs.schema
    found = both.select("a", "b", "left_text", "right_text").mapInArrow(
        lambda batches: _verify(batches, words), f"u {kinds['a'].dataType.simpleString()}, v {kinds['b'].dataType.simpleString()}"
    )
    return staged(found.distinct(), "join-links")


def sizes_fit(n: Column, m: Column) -> Column:
    return F.least(n, m) * UNDER >= F.greatest(n, m) * OVER


def token_map(shared: DataFrame) -> np.ndarray:
    """A bitmap of fixed size that has the bits of all given tokens, and by chance those of some others."""
    place = F.col("token").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    bit = place.bitwiseAND(F.lit((1 << MAP_WORD) - 1)).cast("int")
    words = shared.groupBy(F.shiftright(place, MAP_WORD).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")
    )
    out = np.zeros(1 << (MAP_BITS - MAP_WORD), np.uint32)
    for batch in words.select(F.col("word").cast("int"), "bits").toArrow().to_batches():
        out[batch.column("word").to_numpy()] = batch.column("bits").to_numpy().astype(np.uint32)
    return out


def _mapped(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Prefixes without the tokens that the map shows to be in one document only."""
    bits = shared.value
    for batch in batches:
        prefixes = batch.column("prefix")
        tokens = prefixes.flatten().to_numpy()
        place = tokens & ((1 << MAP_BITS) - 1)
        kept = (bits[place >> MAP_WORD] >> (place & ((1 << MAP_WORD) - 1)).astype(np.uint32)) & 1 == 1
        lengths = np.diff(prefixes.offsets.to_numpy())
        owner = np.repeat(np.arange(len(lengths)), lengths)[kept]
        yield pa.RecordBatch.from_arrays(
            [batch.column("d").take(pa.array(owner)), batch.column("n").take(pa.array(owner)), pa.array(tokens[kept])],
            names=["d", "n", "token"],
        )


def prefix_tokens(n: Column) -> Column:
    """``prefix_length`` as an expression."""
    return F.least(n, n - F.ceil(n * OVER / UNDER) + 2 + F.floor(n / STRETCH))


def leader_pairs(hits: DataFrame, leader: str) -> DataFrame:
    """Each document with the one document that leads most of its shared tokens, where they are many."""
    shared = hits.where(F.col("d") != F.col(leader)).groupBy("d", F.col(leader).alias("led")).agg(
        F.count("*").alias("c"), F.first("n").alias("n")
    )
    shared = shared.where(F.col("c") * 8 >= F.col("n"))
    best = shared.groupBy("d").agg(F.max(F.struct("c", (-F.col("led")).alias("led"))).alias("best"))
    return best.select(F.col("d").alias("a"), (-F.col("best.led")).alias("b"))


def with_component(rows: DataFrame, member: DataFrame) -> DataFrame:
    known = member.select(F.col("node").alias("__node"), "component")
    return (
        rows.join(known, F.col("d") == F.col("__node"), "left")
        .withColumn("component", F.coalesce("component", "d"))
        .drop("__node")
    )


def spanning(postings: DataFrame, key: list[str]) -> DataFrame:
    """Postings of the tokens (or token pairs) that documents of more than one component hold, with their ``df``."""
    wide = postings.groupBy(*key).agg(
        F.count("*").alias("df"), F.min("component").alias("low"), F.max("component").alias("high")
    ).where("low <> high").select(*key, "df")
    return postings.join(wide, key)


def across(postings: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of documents of different components that share a key and that ``most`` spanning frequent tokens of each might link.

    Of a linked pair that shares such tokens only, the smaller set consists of them by six sevenths and the larger by three
    quarters (at a similarity of 0.75). So the first are compared with the second, and not the second with each other.
    """
    n, m = F.col("n"), F.col("m")
    core = postings.where(F.col("most") * (UNDER + OVER) >= n * 2 * OVER)
    other = postings.select(
        *key, F.col("d").alias("b"), F.col("n").alias("m"), F.col("component").alias("other"), F.col("frequent").alias("others"),
        F.col("most").alias("theirs"),
    )
    met = core.join(other, key).where("component <> other AND (n < m OR n = m AND d < b)")
    met = met.where(F.least("most", "theirs") * (UNDER + OVER) >= (n + m) * OVER)
    return met.groupBy(F.least("d", "b").alias("a"), F.greatest("d", "b").alias("b")).agg(
        F.first("n").alias("n"), F.first("m").alias("m"), F.least(F.first("frequent"), F.first("others")).alias("frequent")
    )


def in_lists(postings: DataFrame) -> DataFrame:
    """The same for rare tokens, most of which come with others that the very same documents hold: each list of
    documents (at most RARE of them) is taken once, with the number of its tokens."""
    member = F.struct("d", "n", "component", "frequent")
    lists = postings.groupBy("token").agg(F.array_sort(F.collect_list(member)).alias("docs")).groupBy("docs").agg(F.count("*").alias("tokens"))
    one = lists.select("tokens", "docs", F.posexplode("docs").alias("place", "x"))
    two = one.select("tokens", "x", F.explode(F.slice("docs", F.col("place") + 2, F.lit(RARE))).alias("y"))
    met = two.where("x.component <> y.component").where(sizes_fit(F.col("x.n"), F.col("y.n")))
    return met.groupBy(F.col("x.d").alias("a"), F.col("y.d").alias("b")).agg(
        F.sum("tokens").alias("shared"), F.first("x.n").alias("n"), F.first("y.n").alias("m"),
        F.least(F.first("x.frequent"), F.first("y.frequent")).alias("frequent"),
    )


def enough(pairs: DataFrame) -> DataFrame:
    """Pairs that may link, by what their prefixes share: the rare tokens counted and, at most, the fewer frequent ones.

    The prefix that ends first is known in full, so the overlap is at most what is shared there and that set's other tokens.
    """
    n, m = F.col("n"), F.col("m")
    overlap = F.ceil((n + m) * OVER / (UNDER + OVER))
    beyond = F.greatest(n - prefix_tokens(n), m - prefix_tokens(m))
    return pairs.where(F.col("shared") + F.col("frequent") >= overlap - beyond).select("a", "b")


def groups_of(n: Column) -> Column:
    """Groups that a document's frequent tokens are dealt to, a power of two.

    Linked sets share k = 2 + n // STRETCH tokens of their prefixes (n of the smaller), more than there are groups at the
    largest power of two up to k - 1, so two of them are in one group. That power differs by a factor of two at most
    between sets that can link, and half of it divides both.
    """
    return F.greatest(F.lit(1), F.pow(F.lit(2.0), F.floor(F.log2(1 + F.floor(n / STRETCH))) - 1).cast("long"))


def token_pairs(postings: DataFrame) -> DataFrame:
    """Pairs of tokens that a document has in one group of its prefix, as postings of their own."""
    dealt = postings.withColumn("grp", F.pmod(F.xxhash64("token"), groups_of(F.col("n"))))
    first = dealt.select("d", "grp", "n", "component", "frequent", "most", F.col("token").alias("t1"))
    second = dealt.select("d", "grp", F.col("token").alias("t2"))
    return first.join(second, ["d", "grp"]).where("t1 < t2").drop("grp")


def near_duplicates(
    docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Components of documents whose sets of word shingles have a Jaccard similarity of at least 0.75.

    Every link between different texts counts, found exactly (shingles are 64-bit hashes):

    1. Documents with equal sets are one class, led by its smallest id.
    2. Tokens are ordered by their hash. Linked sets share at least ``2 + n // 16`` tokens (n of the smaller one) within
       their extended prefixes, so only prefixes are indexed, and only tokens of at least two documents are kept.
    3. Each document is compared with the first, then with the last document of most of its tokens. That joins large
       groups of near copies without pairing their members. Tokens held within one component say nothing new and go.
    4. Rare tokens (at most 16 documents) that span components make candidates one by one; pairs that share too little of their
       prefixes for a link, counting all frequent tokens as shared, go. Documents that have so many frequent
       spanning tokens that they might be linked by those alone go on: their whole sets are ordered rarest first, and in their
       extended prefixes rare tokens are signatures alone and frequent ones in pairs, within groups of tokens
       of which one must hold two common ones of any linked pair. The first token that a linked pair shares stands in both prefixes,
       so a pair that shares any rare token has met by one; all others share frequent tokens only, which must then be six
       sevenths of the smaller set. So a passage that very many documents share makes candidates only where it is that much of one.
    5. Candidates are verified on whole texts, and components closed over all verified links.

    Nothing is capped: every token, pair and candidate of these lists is used. Null and empty text has no shingles and links
    with nothing; fewer than five words are one shingle; rows that share an id are one node of the graph; rows without
    an id link with nothing and have no component; an empty table gives an empty table; other columns are not looked at. Returns
    ``doc_id``, ``n_shingles``, ``component_id``, ``class_id`` (smallest id with an equal set) for each row.
    """
    ship_code(docs.sparkSession)
    return finished(docs.sparkSession, "join-result", lambda: _near_duplicates(docs, words, id_col, text_col))


def _near_duplicates(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    sets = staged(
        texts.mapInArrow(
            lambda batches: _prefixes(batches, words), "doc_id long, n long, set_hash binary, prefix array<long>"
        ),
        "join-sets",
    )
    # 1. Classes of equal sets.
    named = sets.where("doc_id IS NOT NULL AND n > 0").select("doc_id", "set_hash")
    classes = staged(named.groupBy("set_hash").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("rows")), "join-classes")
    copies = named.join(classes.where("rows > 1"), "set_hash").where("doc_id <> class_id")
    copies = staged(copies.select("class_id", "doc_id", "set_hash").distinct(), "join-copies")
    led = sets.where("doc_id IS NOT NULL AND n > 0").join(
        bounded(copies.select("doc_id", "set_hash"), BROADCAST_IDS), ["doc_id", "set_hash"], "left_anti"
    )
    # 2. Postings of the prefixes; df, first and last document of every token of several.
    entries = led.select(F.col("doc_id").alias("d"), "n", "prefix")
    repeated = entries.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    bits = spark.sparkContext.broadcast(token_map(repeated))
    postings = entries.mapInArrow(lambda batches: _mapped(batches, bits), "d long, n long, token long")
    postings = staged(postings, "join-postings")
    bits.destroy()
    give_back()
    shared = postings.groupBy("token").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first <> last")
    hits = staged(postings.join(shared, "token"), "join-hits")
    # 3. Large groups, by their leaders.
    links = verified(staged(leader_pairs(hits, "first"), "join-pairs"), texts, words)
    member = components(links, "join-components")
    rest = spanning(with_component(hits.select("d", "n", "token", "last"), member), ["token"]).drop("df")
    again = verified(staged(leader_pairs(rest, "last"), "join-pairs"), texts, words)
    links = links.union(again)
    member = components(links, "join-components")
    # 4. What still spans components.
    rest = staged(
        spanning(with_component(hits.select("d", "n", "token"), member), ["token"]).select("d", "n", "token", "component", "df"),
        "join-spanning",
    )
    many = rest.where(F.col("df") > RARE).groupBy("d").agg(F.count("*").alias("frequent"), F.first("n").alias("n"))
    many = staged(many, "join-frequent")
    rare = rest.where(F.col("df") <= RARE).drop("df").join(many.select("d", "frequent"), "d", "left")
    pairs = enough(in_lists(rare.withColumn("frequent", F.coalesce("frequent", F.lit(0)))))
    least = 2 + F.floor(F.ceil(F.col("n") * OVER / UNDER) / STRETCH)
    laden = staged(many.where(F.col("frequent") >= least).select(F.col("d").alias("doc_id")), "join-laden")
    whole = texts.join(bounded(laden, BROADCAST_IDS), "doc_id", "left_semi").mapInArrow(
        lambda batches: _whole_sets(batches, words), "d long, n long, tokens array<long>"
    )
    tokens = staged(with_component(whole.select("d", "n", F.explode("tokens").alias("token")).distinct(), member), "join-whole")
    counted = tokens.groupBy("token").agg(
        F.count("*").alias("df"), F.min("component").alias("low"), F.max("component").alias("high")
    ).where("low <> high").select("token", "df")
    own = Window.partitionBy("d")
    ahead = tokens.join(counted, "token", "left").withColumns({
        "place": F.row_number().over(own.orderBy(F.coalesce("df", F.lit(1)), "token")),
        "most": F.count(F.when(F.col("df") > RARE, 1)).over(own),
    })
    ahead = staged(ahead.where(F.col("place") <= prefix_tokens(F.col("n"))).where("df > 1").drop("place"), "join-ahead")
    often = staged(ahead.where(F.col("df") > RARE).groupBy("d").agg(F.count("*").alias("frequent")), "join-often")
    ahead = ahead.join(often, "d", "left").withColumn("frequent", F.coalesce("frequent", F.lit(0)))
    alone = ahead.where(F.col("df") <= RARE).drop("df")
    frequent = ahead.where(F.col("df") > RARE).where(F.col("most") * UNDER >= F.col("n") * OVER).drop("df")
    doubles = spanning(token_pairs(frequent), ["t1", "t2"]).drop("df")
    met = in_lists(alone).unionByName(across(doubles, ["t1", "t2"]).withColumn("shared", F.lit(0).cast("long")))
    met = met.groupBy("a", "b").agg(
        F.max("shared").alias("shared"), F.first("n").alias("n"), F.first("m").alias("m"), F.first("frequent").alias("frequent")
    )
    pairs = staged(pairs.union(enough(met)).distinct(), "join-pairs")
    # 5. Verification and closure.
    links = links.union(verified(pairs, texts, words)).union(copies.select("class_id", "doc_id"))
    member = components(links, "join-components").select(F.col("node").alias("doc_id"), "component")
    first = classes.select("set_hash", "class_id")
    told = sets.select("doc_id", "n", "set_hash").join(member, "doc_id", "left").join(first, "set_hash", "left")
    return told.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
        F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
    )


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that lead their component, and those without an id, with all their columns."""
    dropped = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("doc_id <> component_id")
    dropped = staged(dropped.select(F.col("doc_id").alias("__dropped")).distinct(), "join-dropped")
    gone = F.col("__dropped") == docs[id_col].cast("long")
    return docs.join(bounded(dropped, BROADCAST_IDS), gone, "left_anti")
