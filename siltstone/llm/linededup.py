"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

Equal lines share a node. Nodes get MinHash signatures over character shingles, banded for high recall. In a band's
small bucket all nodes meet; in a larger one every node first meets the bucket's representative, its most frequent
node. Pairs whose sketches are close are verified by the exact Jaccard similarity of their character 5-gram sets, links
are joined by distributed union-find, and of each component the first line stays. Members of a larger bucket that stand
in different components after that meet each other as well, in tiles of bounded size.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from random import Random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.components import connected_components
from siltstone.session import Scratch, tidy

#: Characters of a shingle and least Jaccard similarity of a link.
SHINGLE, SIMILAR = 5, 0.8
#: A signature has BANDS bands of ROWS minima. Of two lines with similarity 0.8 about 95 of 100 share a band, with 0.83
#: 98, of two unrelated ones (up to about 0.12) next to none.
BANDS, ROWS = 8, 5
#: Lines of more shingles than FULL are signed by one in RATE of them, chosen by their hashes; lines of up to BOTH, and
#: longer ones in which shingles often repeat, by all. In between both count, so any two similar lines share a scheme.
FULL, BOTH, RATE = 160, 200, 8
#: Places at which a long line is tried for repeats, and how many different shingles tell that it has few.
TRIED, VARIED = 32, 30
#: A sketch has two bits of each of the first SKETCH minima, and those of candidates differ at CLOSE of them at most;
#: similar lines that share a band differ at 4 on the average.
SKETCH, CLOSE = 31, 11
#: Parts in which the bands are dealt out by key, one after the other: what is shuffled at once is so much less.
ROUNDS = 3
#: Members of a bucket that all meet each other at once; in a larger one they meet its representative first.
SMALL = 8
#: Nodes in a chunk of a large bucket.
CHUNK = 256
#: Words of 64 bits in the set that bounds the similarity of two lines before they are compared.
WORDS = 48
#: Bits, as a power of two, of the filter that holds back lines which nobody asks for; its size is fixed.
FILTER_BITS = 24
_NODE_BITS = 58
_NODE = (1 << _NODE_BITS) - 1


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, version, line_no, line, node, proof) of every line that is not blank.

    A line is what stands between \n, less spaces, tabs and carriage returns at its ends. version tells texts of one
    doc_id apart; node is 58 bits of the line's hash, proof 64 bits of another one.
    """
    # The text is hashed and split before its lines are dealt out, once a document.
    whole = docs.select("doc_id", F.xxhash64("text").alias("version"), F.split("text", "\n").alias("parts"))
    parts = whole.select("doc_id", "version", F.posexplode_outer("parts").alias("line_no", "raw"))
    # btrim goes through the whole line, which most lines do not need.
    ends = reduce(or_, (F.col("raw").startswith(c) | F.col("raw").endswith(c) for c in " \t\r"))
    line = F.when(ends, F.btrim("raw", F.lit(" \t\r"))).otherwise(F.col("raw"))
    cut = parts.select("doc_id", "version", "line_no", line.alias("line")).where("line <> ''")
    node = F.shiftrightunsigned(F.xxhash64("line"), 64 - _NODE_BITS)
    return cut.select("*", node.alias("node"), F.xxhash64("line", F.lit(1)).alias("proof"))


def _salt(place: int) -> int:
    """Spread over the range of an int, so that minima of one hash look at different shingles."""
    return (place + 1) * 0x9E3779B9 % 2**32 - 2**31


def sketch_of(minima: list[Column]) -> Column:
    """Two bits of each of the first minima."""
    out = F.lit(0).cast("long")
    for k, m in enumerate(minima[:SKETCH]):
        out = out.bitwiseOR(F.shiftleft(m.bitwiseAND(F.lit(3)).cast("long"), 2 * k))
    return out


def _close(x: str, y: str) -> Column:
    """Whether two sketches differ at few places."""
    odd = F.lit(0x5555555555555555)
    both = F.col(x).bitwiseXOR(F.col(y))
    return F.bit_count(both.bitwiseOR(F.shiftrightunsigned(both, 1)).bitwiseAND(odd)) <= CLOSE


def packed(node: Column, occurs: Column) -> Column:
    """How often a node occurs, in powers of two, above its bits: the largest is the most frequent node."""
    weight = F.least(F.floor(F.log2(occurs)), F.lit(30)).cast("long")
    return F.shiftleft(weight, _NODE_BITS).bitwiseOR(node)


def signatures(lines: DataFrame) -> DataFrame:
    """(node, home, packed, sketch, keys), once for each scheme by which a node is signed; home is a document that has it.

    A signature's place has the least of one of BANDS hashes of the shingles, after XOR with the place's salt.
    """
    # Four bytes a character, so that a shingle is cut out in constant time.
    wide = lines.select("node", _home().alias("home"), F.encode("line", "UTF-32").alias("wide"))
    wide = wide.withColumn("last", F.greatest(F.floor(F.length("wide") / 4).cast("int") - SHINGLE, F.lit(0)))
    shingle = lambda at: F.hash(F.substring("wide", at * 4 + 1, F.lit(4 * SHINGLE)))
    # Irregular places, so that no period of a text falls in with them, each in a part of its own, so that only repeats
    # are found equal.
    draw = Random(TRIED)
    places = F.array(*(F.lit((k + draw.random()) / TRIED) for k in range(TRIED)))
    tried = F.transform(places, lambda x: shingle(F.floor(F.col("last") * x).cast("int")))
    few = (F.col("last") < BOTH) | (F.size(F.array_distinct(tried)) < VARIED)
    schemes = F.when(F.col("last") < FULL, F.array(F.lit(0))).when(few, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    dealt = wide.select("node", "home", "wide", "last", F.explode(schemes).alias("scheme"))
    dealt = dealt.select("node", "home", "wide", "scheme", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("at"))
    each = dealt.select("node", "home", "scheme", shingle(F.col("at")).alias("h"))
    each = each.where(f"scheme = 0 OR h & {RATE - 1} = 0")
    each = each.select("node", "home", "scheme", *(F.hash("h", F.lit(r)).alias(f"h{r}") for r in range(BANDS)))
    # Place j of band b takes hash b + j, so that no band has one twice.
    mins = [F.min(F.col(f"h{(k // ROWS + k % ROWS) % BANDS}").bitwiseXOR(F.lit(_salt(k)))).alias(f"m{k}") for k in range(BANDS * ROWS)]
    signed = each.groupBy("node", "scheme").agg(F.count("*").alias("occurs"), F.min("home").alias("home"), *mins)
    keys = F.array(*(F.xxhash64(F.lit(b), "scheme", *(f"m{ROWS * b + j}" for j in range(ROWS))) for b in range(BANDS)))
    sketch = sketch_of([F.col(f"m{k}") for k in range(BANDS * ROWS)])
    return signed.select("node", "home", packed(F.col("node"), F.col("occurs")).alias("packed"), sketch.alias("sketch"), keys.alias("keys"))


def _home() -> Column:
    """The smallest of these over a line's occurrences says where to fetch it."""
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))


def bucket_members(signed: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node, sketch, top, top_sketch, n) of the buckets that several nodes share, with each one's representative; kept.

    Sketches tell how the members of a bucket differ: in a bucket of two the representative's is 0.
    """

    def banded(keys: Column) -> DataFrame:
        return signed.select("packed", "sketch", F.explode(keys).alias("key"))

    def shared(part: int) -> DataFrame:
        # A slice is compiled code, a filter by position is not.
        width = F.ceil(F.size("keys") / ROUNDS).cast("int")
        found = banded(F.slice("keys", width * part + 1, width)).groupBy("key")
        found = found.agg(F.count("*").alias("n"), F.max("packed").alias("top"), F.min("packed").alias("low"), F.bit_xor("sketch").alias("apart"))
        return scratch.keep(found.where("n > 1"))

    # Keys of different bands are different, so a bucket's rows meet in one part.
    parts = [shared(k) for k in range(ROUNDS)]
    buckets = reduce(DataFrame.unionByName, parts)
    # The least and the largest are all that a bucket of two has, so that only the others' rows are looked up.
    zero = F.lit(0).cast("long")
    both = F.inline(F.array(F.struct(F.col("top").alias("packed"), zero.alias("sketch")), F.struct(F.col("low").alias("packed"), F.col("apart").alias("sketch"))))
    twos = buckets.where("n = 2").select("key", both, "top", zero.alias("top_sketch"), "n")
    large = buckets.where("n > 2").select("key", "top", "n")
    rows = scratch.keep(asked_and_clear(banded(F.col("keys")), large, "key")[0].join(large, "key"))
    tops = rows.where("packed = top").select("key", F.col("sketch").alias("top_sketch"))
    held = twos.unionByName(rows.join(tops, "key"))
    node, top = (F.col(c).bitwiseAND(F.lit(_NODE)).alias(n) for c, n in (("packed", "node"), ("top", "top")))
    members = scratch.keep(held.select("key", node, "sketch", top, "top_sketch", "n"))
    scratch.drop(rows, *parts)
    tidy(scratch.spark)
    return members


def candidate_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of close nodes that meet: all of a small bucket, and each with its representative."""
    first = members.where("node <> top").where(_close("sketch", "top_sketch")).select(F.col("node").alias("p"), F.col("top").alias("q"))
    few = members.where(f"n > 2 AND n <= {SMALL} AND node <> top")
    x, y = (few.select("key", F.col("node").alias(n), F.col("sketch").alias(f"sketch_{n}")) for n in ("p", "q"))
    others = x.join(y, "key").where("p < q").where(_close("sketch_p", "sketch_q")).select("p", "q")
    return first.unionByName(others).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def split_members(members: DataFrame, component: DataFrame) -> DataFrame:
    """(key, node, class, sketch, chunks, lead) of the buckets that are not small and whose members stand in several
    components, but for their representatives, which have met all others; lead: whether it is in the component of its
    bucket's representative."""
    named = members.where(f"n > {SMALL}").join(component, "node", "left").withColumn("class", F.coalesce("component", "node"))
    split = named.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max(F.expr("CASE WHEN node = top THEN class END")).alias("led"))
    held = named.join(split.where("low < high").select("key", "led"), "key").where("node <> top")
    return held.select("key", "node", "class", "sketch", F.ceil(F.col("n") / CHUNK).alias("chunks"), F.expr("class = led").alias("lead"))


def _tiles(held: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame, Column]:
    """The two sides on which members meet, and when they do: once each pair of close ones in different classes.

    A bucket is cut into chunks of about CHUNK nodes, which meet the nodes outside the representative's component, so no
    task gets a whole large bucket's pairs. Two nodes of that component need not meet, so only the others are repeated.
    """
    lead = F.col("lead") if "lead" in held.columns else F.lit(False)
    dealt = held.withColumn("lead", lead).withColumn("at", F.pmod(F.xxhash64("node"), F.col("chunks")))
    others = dealt.where("NOT lead").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    names = ("key", "at", "lead", "node", "class", "sketch", *columns)
    x, y = (side.select(*(F.col(c).alias(f"{c}_{n}") for c in names)) for side, n in ((others, "a"), (dealt, "b")))
    same = F.expr("key_a = key_b AND at_a = at_b AND class_a <> class_b AND (lead_b OR node_a < node_b)")
    return x, y, same & _close("sketch_a", "sketch_b")


def with_partners(held: DataFrame) -> DataFrame:
    """The rows of `held` that have a close partner in their bucket."""
    x, y, meet = _tiles(held, [])
    some = x.join(y, meet, "left_semi").select(F.col("key_a").alias("key"), F.col("node_a").alias("node"))
    more = y.join(x, meet, "left_semi").select(F.col("key_b").alias("key"), F.col("node_b").alias("node"))
    return held.join(some.unionByName(more).distinct(), ["key", "node"], "left_semi")


def marks_of(texts: DataFrame) -> DataFrame:
    """(node, size, bits): the number of a line's shingles, and a set of bits, in words, with one for each of them."""
    wide = texts.select("node", F.encode("line", "UTF-32").alias("wide"))
    size = F.greatest(F.floor(F.length("wide") / 4).cast("int") - SHINGLE + 1, F.lit(1))
    dealt = wide.select("node", "wide", size.alias("size"), F.explode(F.sequence(F.lit(0), size - 1)).alias("at"))
    each = dealt.select("node", "size", F.hash(F.substring("wide", F.col("at") * 4 + 1, F.lit(4 * SHINGLE))).alias("h"))
    each = each.select("node", "size", F.expr("shiftleft(1L, h & 63)").alias("bit"), F.expr(f"pmod(shiftright(h, 6), {WORDS})").alias("word"))
    # Bits of a word are put together first, so that few rows are tried for every word.
    words = each.groupBy("node", "word").agg(F.max("size").alias("size"), F.bit_or("bit").alias("bit"))
    sets = (F.coalesce(F.bit_or(F.when(F.col("word") == k, F.col("bit"))), F.lit(0).cast("long")) for k in range(WORDS))
    return words.groupBy("node").agg(F.max("size").alias("size"), F.array(*sets).alias("bits"))


def _may_be_similar(similar: float) -> Column:
    """Whether marks leave it open that two lines are similar: each bit that one of them has alone is a shingle that it
    has alone, so they bound the similarity from above."""

    def only(x: str, y: str) -> Column:
        alone = F.zip_with(f"bits_{x}", f"bits_{y}", lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))))
        return F.aggregate(alone, F.lit(0), lambda n, k: n + k)

    # Each count is worked out once.
    counts = F.array(F.struct(only("a", "b").alias("a"), only("b", "a").alias("b")))
    both = lambda c: F.least(F.col("size_a") - c["a"], F.col("size_b") - c["b"])
    return F.transform(counts, lambda c: both(c) >= similar * (both(c) + c["a"] + c["b"]))[0]


def other_pairs(held: DataFrame, keys: DataFrame, marks: DataFrame, similar: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of members of a bucket that stand in two components and may be similar.

    `keys` are the (node, keys) that buckets were made of: two nodes meet in the first bucket that they share.
    """
    named = held.join(keys, "node").where(F.array_contains("keys", F.col("key"))).join(marks, "node")
    x, y, meet = _tiles(named, ["keys", "size", "bits"])
    first = F.expr("element_at(array_intersect(keys_a, keys_b), 1) = key_a")
    met = x.join(y, meet & first & _may_be_similar(similar))
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def similar_pairs(joined: DataFrame, similar: float) -> DataFrame:
    """(a, b) of the rows (a, b, line_a, line_b) whose lines' shingle sets have at least this exact Jaccard similarity."""

    def hashed(line: str) -> Column:
        # Four bytes a character, so that a shingle is cut out in constant time.
        def shingles(wide: Column) -> Column:
            last = F.greatest(F.length(wide) - 4 * SHINGLE, F.lit(0)) + 1
            # Only what must be is in the lambda, which is interpreted.
            cut = lambda i: F.xxhash64(F.substring(wide, i, F.lit(4 * SHINGLE)))
            return F.transform(F.sequence(F.lit(1), last, F.lit(4)), cut)

        return F.transform(F.array(F.encode(line, "UTF-32")), shingles)[0]

    # A filter does not move below a generator, so each line is hashed once a pair and the sets are met in compiled code.
    both = F.inline(F.array(F.struct(hashed("line_a").alias("x"), hashed("line_b").alias("y"))))
    # Intersection and union count a repeated shingle once.
    share = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return joined.select("a", "b", both).where(share >= similar).select("a", "b")


def asked_and_clear(rows: DataFrame, wanted: DataFrame, by: str = "node") -> tuple[DataFrame, DataFrame]:
    """`rows` in two: those whose column `by`, a hash, may be in that of `wanted`, and those whose is not.

    A set of 2**FILTER_BITS bits, 64 to a row, is broadcast: its size does not grow. The more is wanted, the fewer rows
    it clears.
    """
    word = F.shiftright(F.col(by).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)), 6)
    bit = F.expr(f"shiftleft(1L, CAST({by} & 63 AS INT))")
    bits = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    met = rows.withColumn("_word", word).join(F.broadcast(bits), "_word", "left")
    hit = F.coalesce(bit.bitwiseAND(F.col("_bits")) != 0, F.lit(False))
    return met.where(hit).drop("_word", "_bits"), met.where(~hit).drop("_word", "_bits")


def wanted_lines(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """`lines` without most of those whose node is not in `wanted` (column node); none of the others is lost."""
    return asked_and_clear(lines, wanted)[0]


def texts_of(wanted: DataFrame, signed: DataFrame, lines: DataFrame) -> DataFrame:
    """(node, proof, line) of the wanted nodes (column node, distinct).

    Each line is fetched from one document that has it, so a line that is everywhere is no skewed key.
    """
    spot = F.xxhash64("node", "home").alias("spot")
    # Not a semi-join, which would be moved below the filter.
    homes = wanted_lines(signed.select("node", "home"), wanted).join(wanted, "node").distinct().select("*", spot)
    found = asked_and_clear(lines.select("node", _home().alias("home"), "proof", "line").select("*", spot), homes, "spot")[0]
    found = found.join(homes, ["node", "home", "spot"])
    one = F.min(F.struct("proof", "line")).alias("one")
    return found.groupBy("node").agg(one).select("node", "one.*")


def verified(pairs: DataFrame, texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs that are similar enough."""
    at_a, at_b = (texts.select(F.col("node").alias(n), F.col("line").alias(f"line_{n}")) for n in ("a", "b"))
    return similar_pairs(pairs.join(at_a, "a").join(at_b, "b"), similar)


def linked(signed: DataFrame, lines: DataFrame, scratch: Scratch, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(node, component) of all nodes that are linked, and (node, proof) of all that were compared.

    Members of a bucket that their links to representatives have joined need not meet; all others do.
    """
    members = bucket_members(signed, scratch)
    pairs = scratch.keep(candidate_pairs(members))
    # Members of larger buckets may meet later on; one scan fetches the lines of all.
    later = members.where(f"n > {SMALL}").select("node")
    texts = scratch.keep(texts_of(ends_of(pairs).unionByName(later).distinct(), signed, lines))
    links = scratch.keep(verified(pairs, texts, similar))
    component = connected_components(links, scratch)
    held = scratch.keep(with_partners(split_members(members, component)))
    scratch.drop(members)
    tidy(scratch.spark)
    if not held.isEmpty():
        more = texts.join(held.select("node").distinct(), "node", "left_semi")
        marks, keys = scratch.keep(marks_of(more)), wanted_lines(signed.select("node", "keys"), held.select("node"))
        others = scratch.keep(other_pairs(held, keys, marks, similar))
        tidy(scratch.spark)
        rest = scratch.keep(verified(others, texts, similar))
        if not rest.isEmpty():
            component = connected_components(links.unionByName(rest), scratch)
    return component, texts.select("node", "proof")


def ends_of(pairs: DataFrame) -> DataFrame:
    """Every node of some pairs, once."""
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def line_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per line that is not blank: doc_id, version, line_no, class_doc_id, class_line_no, kept.

    The class is named by its first line in the order of doc_id (null last), line_no and version, which is the one kept.
    Equal lines are always one class; different lines are linked if the Jaccard similarity of their character 5-gram
    sets is at least `similar`, and classes are closed over links. A line shorter than five characters is one shingle.
    Blank lines are never duplicates; null and empty texts have none. Rows that repeat a doc_id and text count as one
    document, and their lines get equal rows. Two lines of one node whose second hashes differ are never merged, nor
    anything with them. Lines of any length are signed and compared whole. Other columns are ignored; an empty table
    gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    lines = lines_of(docs)
    signed = scratch.keep(signatures(lines))
    component, proofs = linked(signed, lines, scratch, similar)
    scratch.drop(signed)
    # Only the line that was verified is in the component, not another one that shares its node.
    component = component.join(proofs, "node")
    places = lines.select("doc_id", "version", "line_no", "node", "proof")
    named = places.join(component, ["node", "proof"], "left").withColumn("class", F.coalesce("component", "node"))
    named = scratch.keep(named.select("doc_id", "version", "line_no", "class", F.when(F.col("component").isNull(), F.col("proof")).alias("proof")))
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no", "version")).alias("first")
    # A node outside every component is told from a colliding one by its proof.
    same = named.groupBy("class", "proof").agg(order, F.count("*").alias("n")).where("n > 1")
    same = same.select(F.col("class").alias("c"), F.col("proof").alias("p"), "first")
    told = named.join(same, F.expr("class = c AND proof <=> p"), "left")
    alone = F.col("c").isNull()
    doc, at, version = F.col("first.doc_id"), F.col("first.line_no"), F.col("first.version")
    first = F.col("doc_id").eqNullSafe(doc) & (F.col("line_no") == at) & F.col("version").eqNullSafe(version)
    return told.select(
        "doc_id",
        "version",
        "line_no",
        F.when(alone, F.col("doc_id")).otherwise(doc).alias("class_doc_id"),
        F.when(alone, F.col("line_no")).otherwise(at).alias("class_line_no"),
        (alone | first).alias("kept"),
    )


def dedup_lines(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """`docs` with every line gone that is not the first of its class; blank lines stay, all columns pass through.

    A document that loses all its lines that are not blank stays, with what is left of its text. Null and empty texts
    stay as they are; rows that repeat a doc_id and text are one document and all lose the same lines. Columns may have
    any name or type; an empty table stays empty.
    """
    gone = line_classes(docs, similar).where("NOT kept").groupBy("doc_id", "version")
    gone = gone.agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    # Other columns stand in one struct meanwhile, so that no name can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("at"), F.xxhash64("text").alias("hash"))
    joined = rows.join(gone, F.expr("at <=> doc_id AND hash = version"), "left")
    # What stands between one line that goes and the next.
    n = F.size("gone")

    def between(k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.get("gone", k - 1) + 1)
        end = F.when(k == n, F.size("parts")).otherwise(F.get("gone", k))
        return F.slice("parts", start + 1, end - start)

    left = F.flatten(F.transform(F.sequence(F.lit(0), n), between))
    whole = F.col("row.text")
    joined = joined.withColumn("parts", F.when(F.col("gone").isNotNull(), F.split(whole, "\n")))
    text = F.when(F.col("gone").isNull(), whole).otherwise(F.array_join(left, "\n"))
    return joined.select(*(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
