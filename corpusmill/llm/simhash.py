"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in r bits have a fingerprint between them that differs from each in at most
ceil(r / 2). So every distinct fingerprint emits all variants within half the radius, variants are shuffled, and
fingerprints that meet on a variant are the candidates. All that meet on one variant lie within the radius of
each other for an even radius; sorted by number, neighbours are linked, which joins them all without all pairs. A
variant has at most as many distinct fingerprints as its ball (65 for radius 2), however many documents share
them. Links are checked by their differing bits, deduplicated, and joined into components.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import HOT, block_pairs, hot_blocks, hot_keys, join_spread, kept, map_frames, packed, text_rows, with_times

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
BLOCK = 1 << 16
#: How many new neighbours a text is given on a key in a round of ``similar_pairs``.
DRAWS = 8


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash: bit set where more than half of the shingles' XXH64 have it; 0 without words."""
    from xxhash import xxh64_intdigest

    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        h = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row, fp as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(t, shingle) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": fps})

    return map_frames(text_rows(docs, id_col, text_col), run, "doc_id long, fp long")


def masks(radius: int, bits: int = 64) -> list[int]:
    """What to flip for every variant within half the radius (rounded up), as signed longs; 0 first."""
    found = [sum(1 << b for b in c) for n in range((radius + 1) // 2 + 1) for c in combinations(range(bits), n)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def links(heads: DataFrame, radius: int = 2) -> DataFrame:
    """heads: (fp, head), each fp once. (u, v) of heads whose fingerprints differ in at most ``radius`` bits, enough to connect all that do."""
    if radius % 2:
        raise ValueError("radius must be even")
    flips = F.explode(F.array(*[F.lit(m).cast("long") for m in masks(radius)]))
    near = heads.select("fp", "head", flips.alias("m")).select("fp", "head", F.col("fp").bitwiseXOR(F.col("m")).alias("variant"))
    by = Window.partitionBy("variant").orderBy("fp")
    pairs = near.select("fp", "head", F.lag("fp").over(by).alias("other_fp"), F.lag("head").over(by).alias("other"))
    met = pairs.where(F.col("other").isNotNull() & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other_fp"))) <= radius))
    return met.select(F.least("head", "other").alias("u"), F.greatest("head", "other").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is its smallest reachable node.

    Alternating large-star and small-star steps: a logarithmic number of rounds, each a few joins on slim rows. Every
    round is written to the shared folder; only counts and a checksum come to the driver. Stars gather many edges on
    one node; the few such nodes are looked up by broadcast, so no task gets all edges of one. Null nodes give no rows.
    """
    edges = kept(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "edges")
    before, n = None, edges.count()
    while True:
        few = lambda rows: packed(rows, 2 * n)  # noqa: B023, E731
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hot = hot_keys(both, "u", 2 * n)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = few(few(join_spread(both, least, "u", hot).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        large = large if hot is None else kept(large, "large")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_spread(large, lower, "u", hot).select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.col("m").alias("y")), F.struct(F.col("u").alias("x"), F.col("m").alias("y")))).alias("e"))
        edges = kept(few(few(small.select(F.col("e.y").alias("u"), F.col("e.x").alias("v")).where(F.col("u") != F.col("v"))).distinct()), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
        before, n = now, now[0]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row.

    Words are runs of anything but space, tab and line characters, with A-Z lower-cased; texts with fewer words than
    a shingle are one shingle, texts without words (null, empty) have fingerprint zero and link like others.
    Repeated rows each give a row. A null doc_id links its group but never names it, unless all its ids are
    null; then component_id is null. Extra columns are not read; an empty table gives no rows.
    """
    fps = kept(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    heads = kept(fps.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("times")), "heads")
    found = kept(components(links(heads.select("fp", F.col("fp").alias("head")), radius)), "components")  # nodes are fingerprints, so ids of any size and none name no node
    names = kept(found.join(heads, F.col("node") == F.col("fp")).groupBy("component").agg(F.min("id").alias("component_id")), "names")
    named = join_spread(found, names, "component", hot_keys(found, "component", found.count())).select(F.col("node").alias("fp"), "component_id", F.lit(True).alias("linked"))
    classes = heads.join(named, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    hot = heads.where(F.col("times") > max(HOT, fps.count() // 4096)).select("fp")
    return join_spread(fps, kept(classes, "classes"), "fp", None if hot.isEmpty() else hot).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def ball_pairs(texts: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v), u < v, by ball hashing of the fingerprints of (doc_id, text), each doc_id once: enough pairs to connect all texts whose fingerprints differ in at most ``radius`` bits. Texts of one fingerprint are paired with the smallest id."""
    fps = kept(fingerprints(texts), "fingerprints")
    heads = kept(fps.groupBy("fp").agg(F.min("doc_id").alias("head")), "heads")
    same = join_spread(fps, heads, "fp", hot_keys(fps, "fp", fps.count())).where("doc_id > head").select(F.col("head").alias("u"), F.col("doc_id").alias("v"))
    return links(heads, radius).union(same)


def words_of(text: str) -> list[bytes]:
    return WORDS(text.translate(UPPER).encode("utf-8", "surrogatepass"))


def shingle_set(text: str, k: int) -> frozenset[bytes]:
    words = words_of(text)
    return frozenset(b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """Sorted distinct XXH64 of ``shingle_set``."""
    from xxhash import xxh64_intdigest

    words = words_of(text)
    joined, k = b" ".join(words), min(k, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist() if words else [0]
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist() if words else [0])), np.uint64))


def parities(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of hashes falls on each of 2**b places, at least as many as there are hashes; 64 places a number."""
    places = 1 << max(8, (len(hashes) - 1).bit_length())
    return np.packbits((np.bincount((hashes & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1).astype(np.uint8)).view(np.int64)


def least_difference(a: np.ndarray, b: np.ndarray) -> int:
    """Two sets with these parities differ in at least so many members; the longer one is folded to the shorter."""
    places = min(len(a), len(b))
    x, y = (np.bitwise_xor.reduce(np.asarray(s, np.int64).reshape(-1, places), axis=0) for s in (a, b))
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())


def frequent(rows: DataFrame, shingle: int, sample: int = 20_000, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in their order, and counts of the ``most`` commonest shingles of about ``sample`` texts. They only come last in the order of shingles, so any answer is right."""
    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("frequent")), F.lit(1_000_000)) <= int(1_000_000 * min(1.0, sample / max(1, n))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": np.concatenate([np.zeros(0, np.uint64), *[shingle_hashes(t, shingle) for t in pdf["text"]]]).view(np.int64)})

    counts = some.select("text").mapInPandas(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 2")
    got = sorted((r["key"] % 2**64, r["n"]) for r in counts.orderBy(F.desc("n"), "key").limit(most).collect())
    return np.array([g[0] for g in got], np.uint64), np.array([g[1] for g in got], np.int64)


def prefixes(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, n, parities, place, keys) of the texts that may have one alike: how many shingles a text has, and those of its rarest that other texts have too.

    Sets alike share ``similarity`` times the larger one's members, so in any one order of all shingles each has a common one
    among all but that many, and one. In the order here two thirds of all shingles (by their hash) come first, those
    that fewest texts have before others; counts are over all texts. As nearly every text finds its rarest ones among
    them, the other third comes by hash and is not counted. The ``frequent`` ones come last, so that no common
    shingle's rows meet in the shuffle that counts. What no other text has is left out; ``place`` is the first key's
    place in the order. Most texts end there.
    """
    known, count = frequent(rows, shingle)
    kind = "doc_id long, n int, open int, most int, keys array<long>, later array<long>, parities array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                h = shingle_hashes(text, shingle)
                most, own, common = len(h) - math.ceil(similarity * len(h) - 1e-6) + 1, h, h[:0]
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    hit = known[at] == h
                    own, common = h[~hit], h[hit][np.lexsort((h[hit], count[at[hit]]))]
                first = own % np.uint64(3) > 0
                own, later = own[first], np.concatenate([own[~first], common])
                mark = np.array([doc_id * 0x9E3779B97F4A7C15 % 2**64], np.uint64)  # a row of its own, that carries what is the text's
                out.append((doc_id, len(h), len(own), most, np.concatenate([own, mark]).view(np.int64), later[: max(0, most - len(own))].view(np.int64), parities(h)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in kind.split(", ")])

    told = F.struct("n", "open", "most", "later", "parities")
    each = rows.mapInPandas(run, kind).select("doc_id", told.alias("told"), F.posexplode("keys").alias("at", "key"))
    each = each.select("key", "doc_id", F.when(F.col("at") == F.col("told.open"), F.col("told")).alias("told"))
    counted = each.withColumn("texts", F.count("*").over(Window.partitionBy("key"))).where("texts > 1 or told is not null")
    own = F.sort_array(F.collect_list(F.when(F.col("told").isNull(), F.struct("texts", "key"))))
    by_text = counted.groupBy("doc_id").agg(own.alias("own"), F.first("told", ignorenulls=True).alias("told")).select("doc_id", "own", "told.*")
    place = F.col("open") - F.size("own")
    keys = F.slice(F.concat(F.transform("own", lambda x: x["key"]), "later"), F.lit(1), F.col("most") - place)
    return by_text.where(place < F.col("most")).select("doc_id", "n", "parities", place.alias("place"), keys.alias("keys"))


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int, similarity: float, salts: int) -> DataFrame:
    """The distinct pairs (u, v) that are alike: those whose parities allow it, held against each other on whole texts, ``salts`` partners of a text in a group or few more."""

    def allowed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            most = (1 - similarity) / (1 + similarity) * (pdf["n"] + pdf["m"]) + 1e-6
            fits = [least_difference(a, b) <= d for a, b, d in zip(pdf["a"], pdf["b"], most)]
            yield pdf.loc[np.array(fits, bool), ["u", "v"]]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own = None, frozenset()
        for pdf in batches:
            out = []
            for doc_id, u, salt, text in zip(pdf["doc_id"], pdf["u"], pdf["salt"], pdf["text"]):
                if doc_id == u:
                    at, own = (u, salt), shingle_set(text, shingle)
                    continue
                assert at == (u, salt)
                their = shingle_set(text, shingle)
                common = len(own & their)
                if common >= similarity * (len(own) + len(their) - common):
                    out.append((u, doc_id))
            yield pd.DataFrame(out, columns=["u", "v"])

    first = sets.select(F.col("doc_id").alias("u"), "n", F.col("parities").alias("a"))
    second = sets.select(F.col("doc_id").alias("v"), F.col("n").alias("m"), F.col("parities").alias("b"))
    hot = hot_keys(pairs, "u", pairs.count())
    fit = join_spread(pairs, first, "u", hot).join(second, "v").select("u", "v", "n", "m", "a", "b").mapInPandas(allowed, "u long, v long")
    fit = with_times(fit, "u", hot)  # a text's groups are as many as its partners need
    groups = F.greatest(F.lit(1), F.ceil(F.coalesce(F.col("times"), F.lit(HOT)) / salts))
    fit = kept(fit.select("u", "v", F.pmod(F.xxhash64("v"), groups).cast("int").alias("salt")), "pairs")
    wanted = fit.select(F.col("v").alias("doc_id"), "u", "salt").union(fit.select(F.col("u").alias("doc_id"), "u", "salt").distinct())
    whole = wanted.join(texts, "doc_id").repartition("u", "salt").sortWithinPartitions("u", "salt", F.col("doc_id") != F.col("u"), "doc_id")
    return kept(whole.select("doc_id", "u", "salt", "text").mapInPandas(verify, "u long, v long"), "alike")


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(node, doc_id, text) of the distinct rows with an id, and whether node is the id itself, as it is where no id repeats.

    Where ids repeat, all rows are numbered in the order of doc_id, then text, by a range sort that is written: no id stands for another's number.
    """
    rows = text_rows(docs).where(F.col("doc_id").isNotNull())
    if docs.select("doc_id").distinct().count() == docs.count():
        return rows.select(F.col("doc_id").alias("node"), "doc_id", "text"), True
    order = "doc_id", "text"
    return kept(rows.distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()).select("node", *order), "numbered"), False


def similar_pairs(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, salts: int = 50) -> DataFrame:
    """(u, v), u < v: pairs of ids whose sets of word shingles have a Jaccard similarity of at least ``similarity``, enough to connect all that have.

    Texts alike share one of their rarest shingles (see ``prefixes``). First each text is held against its neighbour and the
    smallest id on each of these; what that verifies is joined into components. While many of those that are tried turn out
    alike, texts of different components on one key are dealt new neighbours and tried again. Then all texts that share one
    and are still of different components are held against each other: only pairs that are connected already are left out.
    Every pair is verified on whole texts. A doc_id with several texts has the pairs of each (of two of its own, none); null ids have no
    pairs; null text is empty; extra columns are not read; an empty table gives no rows.
    """
    rows, own = numbered(docs)
    found = connected(rows.select(F.col("node").alias("doc_id"), "text"), shingle, similarity, salts)[0]
    if own:
        return found
    ids = lambda x: rows.select(F.col("node").alias(x), F.col("doc_id").alias(f"{x}_id"))
    named = found.join(ids("u"), "u").join(ids("v"), "v").select(F.col("u_id").alias("u"), F.col("v_id").alias("v"))
    return named.where("u < v").distinct()


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, group) after links (u, v) joined some groups: only links between groups are followed, each pair of groups once. Nodes without a label are groups of their own."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("group").alias(f"{x}_group"))
    both = links.join(of("u"), "u", "left").join(of("v"), "v", "left")
    ends = F.coalesce("u_group", "u"), F.coalesce("v_group", "v")
    between = both.select(F.least(*ends).alias("u"), F.greatest(*ends).alias("v")).where("u < v").distinct()
    found = kept(components(between), "merged")
    new = labels.join(found.select(F.col("node").alias("group"), "component"), "group", "left").select("node", F.coalesce("component", "group").alias("group"))
    alone = found.join(labels.select("node"), "node", "left_anti").select("node", F.col("component").alias("group"))
    return kept(new.unionByName(alone), "labels")


def differing(a, b):
    """``least_difference`` of two arrays of longs as a column: the bits in which they differ, the longer one folded to the shorter."""
    folded = lambda x, y: F.when(F.size(x) > F.size(y), fold(x, F.size(y))).otherwise(x)
    fold = lambda x, n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(F.sequence(F.lit(0), F.floor(F.size(x) / n).cast("int") - 1), F.lit(0).cast("long"), lambda acc, j: acc.bitwiseXOR(F.get(x, i + j * n))))
    return F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def connected(texts: DataFrame, shingle: int, similarity: float, salts: int = 50) -> tuple[DataFrame, DataFrame]:
    """``similar_pairs`` of (doc_id, text) with each doc_id once, and the (node, group) that they make of the texts that have any, group being its least node.

    The first candidates are those of ball hashing; as texts alike can differ in more bits than a ball reaches, those that share a rare shingle come beside them.
    """
    sets = kept(prefixes(texts, shingle, similarity), "prefixes")
    early = F.when(F.col("row.place") <= (1 - similarity) / (1 + similarity) * F.col("row.n") + 1e-6, F.col("row"))  # rows that can meet one of their own size on the key

    def before(order):
        return F.last(early, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))

    def head(part):
        return F.min_by(early, F.when(early.isNotNull(), F.col("row.doc_id"))).over(part)

    check = lambda pairs: verified(pairs, sets, texts, shingle, similarity, salts)
    each = sets.select("doc_id", "n", F.posexplode("keys").alias("at", "key"), F.col("place").alias("from"))
    each = kept(each.select("key", F.struct("doc_id", "n", (F.col("from") + F.col("at")).alias("place")).alias("row")), "each")
    total = each.count()
    hot = hot_keys(each, "key", total)
    part = F.pmod(F.xxhash64("row.doc_id"), F.ceil(F.coalesce(F.col("times"), F.lit(1)) / max(HOT, total // 4096)))
    by, of = Window.partitionBy("key", "salt").orderBy("row.n", "row.doc_id"), Window.partitionBy("key", "salt")
    met = with_times(each, "key", hot).select("key", "row", part.cast("int").alias("salt"), F.col("times").isNotNull().alias("hot"))
    met = met.select("key", "row", "hot", before(by).alias("last"), head(of).alias("head"), F.count("*").over(of).alias("held"))
    met = kept(met.where("hot or held > 1"), "met")

    def fits(a: str, b: str):
        """Sizes and places allow it: of sets alike, what is left of each from their first common shingle on holds all they share."""
        n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
        left = F.least(n - F.col(f"{a}.place"), m - F.col(f"{b}.place"))
        return (left >= similarity / (1 + similarity) * (n + m) - 1e-6) & (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6)

    def pairs_of(rows: DataFrame, other: str) -> DataFrame:
        ids = F.col(f"{other}.doc_id"), F.col("row.doc_id")
        return rows.where((ids[0] != ids[1]) & fits(other, "row")).select(F.least(*ids).alias("u"), F.greatest(*ids).alias("v"))

    # a hot key's rows are dealt to several windows; their heads, one a window, meet once more
    tops = met.where("hot and row.doc_id = head.doc_id").select("key", "row")
    on, of = Window.partitionBy("key").orderBy("row.n", "row.doc_id"), Window.partitionBy("key")
    tops = tops.select("key", "row", before(on).alias("last"), head(of).alias("head"))
    near = pairs_of(met, "last").union(pairs_of(met, "head"))
    near = near if hot is None else near.union(pairs_of(tops, "last")).union(pairs_of(tops, "head"))
    found = check(kept(near.union(ball_pairs(texts)).distinct(), "near"))
    labels = kept(components(found).withColumnRenamed("component", "group"), "labels")
    seed = 0
    while True:
        own = kept(met.select("key", "row", F.col("row.doc_id").alias("node")).join(labels, "node", "left").select("key", "row", F.coalesce("group", "node").alias("group")), "own")
        several = own.groupBy("key").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least < most").select("key")
        several = several if hot is None else kept(several, "several")
        open_ = kept(join_spread(own, several, "key", hot), "open")
        anew = kept(pairs_of(shuffled(open_, before, hot, total, range(seed, seed + DRAWS)), "last").distinct(), "anew")
        more = check(anew)
        n, alike, seed = anew.count(), more.count(), seed + DRAWS
        if not alike:
            break
        found, labels = kept(found.union(more), "found"), merged(labels, more)
        if 20 * alike < n or alike < 32:  # few are alike: what is left is mostly alone
            open_ = kept(open_.select("key", "row", F.col("row.doc_id").alias("node")).join(labels, "node", "left").select("key", "row", F.coalesce("group", "node").alias("group")), "open")
            break
    bits = sets.select(F.col("doc_id").alias("node"), "parities")
    open_ = kept(open_.withColumn("node", F.col("row.doc_id")).join(bits, "node"), "open")
    met = block_pairs(open_, "key", "node", hot_blocks(open_, "key"))
    most = (1 - similarity) / (1 + similarity) * (F.col("a.row.n") + F.col("b.row.n")) + 1e-6
    rest = met.where((F.col("a.group") != F.col("b.group")) & fits("a.row", "b.row") & (differing(F.col("a.parities"), F.col("b.parities")) <= most))
    ids = F.col("a.node"), F.col("b.node")
    last = check(kept(rest.select(F.least(*ids).alias("u"), F.greatest(*ids).alias("v")).distinct(), "rest"))
    return found.union(last), merged(labels, last)


def shuffled(rows: DataFrame, before, hot: DataFrame | None, total: int, seeds: range) -> DataFrame:
    """For each seed one row of each group on a key, that with the first place there, and as ``last`` the early one of another group before it in an order by size that each seed jolts anew (by up to a quarter, as sizes of texts alike differ).

    The seeds go through one plan together: a plan for each would have as many times its stages, tasks and broadcasts.
    """
    rows = rows.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    draw = F.xxhash64("group", "seed")
    turn = F.row_number().over(Window.partitionBy("seed", "key", "group").orderBy(F.col("row.place") / F.col("row.n"), F.xxhash64("row.doc_id", "seed"), "row.doc_id"))
    rows = with_times(rows.withColumn("turn", turn).where("turn = 1"), "key", hot)
    part = F.pmod(draw, F.ceil(F.coalesce(F.col("times"), F.lit(1)) / max(HOT, total // 4096))).cast("int")
    size = F.col("row.n") * (1 + F.pmod(draw, F.lit(1000)) / 4000.0)
    return rows.withColumn("part", part).withColumn("last", before(Window.partitionBy("seed", "key", "part").orderBy(size, "group"))).where("last is not null").select("key", "row", "last")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the rows whose group of similar texts has a smaller doc_id; columns as they were.

    Groups are the components of ``similar_pairs``. Rows go by id and text, so another text under the same id stays. Rows
    with a null doc_id and equal rows of an id stay; null text is empty, and empty texts are alike. An empty table stays empty.
    """
    rows, unique = numbered(docs)
    found = connected(rows.select(F.col("node").alias("doc_id"), "text"), shingle, similarity)[1]
    gone = found.where(F.col("node") != F.col("group"))
    own = docs["doc_id"].cast("long")
    if unique:
        gone = gone.select(F.col("node").alias("__gone"))
        return docs.join(gone, own == gone["__gone"], "left_anti")
    mark = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    gone = kept(rows.join(gone, "node").select(F.col("doc_id").alias("__gone"), F.xxhash64("text").alias("__text")), "gone")
    return docs.join(gone, (own == gone["__gone"]) & (mark == gone["__text"]), "left_anti")
