r"""Near-duplicate classes: BagMinHash signatures, banding, exact verification, components.

Texts are lower-cased (A-Z) and cut into words (runs of anything but space and
\x09-\x0D); a document is the multiset of its runs of five words, a shorter one is one
run. Two documents are linked if their multiset Jaccard similarity (sum of minima over
sum of maxima) is at least 0.8, and classes are the connected components of the links.

1. Texts equal up to the case of A-Z are one text (md5), so copies cost one signature.
2. A BagMinHash signature of 80 slots is cut into 20 bands of 4. Two texts at 0.8 share a
   band with probability 1 - (1 - 0.8^4)^20 = 0.99997, at 0.9 with 1 - 6e-10.
3. Texts that share a band fall into one bucket and are compared with one of them, its
   centre. Links merge classes. Most buckets are done then: two members, or copies of one
   text. In those that still hold several classes, all members are compared with the
   ``HUBS`` best linked ones, which finds the texts the others were copied from. For what
   remains, prefix filtering finds every pair of texts of different classes that can
   reach 0.8, so no link within a bucket is lost, and the pairs do not grow with the square of a group
   of copies. Pairs whose sizes alone rule out 0.8 are never compared.
4. A pair is verified on both whole texts: overlap of the multisets, in numpy, for
   batches of pairs.

Hot groups: copies collapse in step 1 before any shuffle of texts; a bucket's members are
joined to its few centres, materialised first, so that AQE can split a hot bucket.

Edge cases: null and empty texts (no words) are each a class of their own; repeated rows
are copies of each other; a null id never names a class unless all ids in it are null;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bagminhash import band_keys, signatures
from .bytescan import SPACE_WORDS, mix, split_words, text_chunks, windows
from .common import WORD, Shared, fold, lean, materialise
from .components import components

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 20, 4
HUBS = 16
SKETCH = 1 << 20
VERIFY_BYTES = 1 << 20
WINDOW = 32
SLICE = 1 << 16


def digested(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, text) without the texts that have no words."""
    body = F.col(f"`{text}`")
    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.unhex(F.md5(fold(body))).alias("digest"),
                       body.alias("text")).where(F.col("text").rlike(WORD))


def runs(data, offsets):
    """Distinct runs of words of each text of a chunk: (text, run hash, count), by text."""
    words = split_words(data, offsets, SPACE_WORDS)
    h, doc, _ = windows(words.hashes(), words.first, SHINGLE)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def band_table(texts: DataFrame) -> DataFrame:
    """(digest, n, bands): runs and band hashes of each text, once per task and digest."""
    def sign(batches):
        seen = set()
        for batch in batches:
            digest, column = batch.column("digest").to_pylist(), batch.column("text")
            for a, b, data, offsets in text_chunks(column):
                new = []
                for i in range(a, b):
                    if digest[i] not in seen:
                        seen.add(digest[i])
                        new.append(i)
                if not new:
                    continue
                if len(new) < b - a:
                    part = next(text_chunks(column.take(pa.array(new))), None)
                    if part is None:
                        continue
                    _, _, data, offsets = part
                doc, run, count = runs(data, offsets)
                keys = band_keys(signatures(doc, run, count, len(new), BANDS * ROWS), BANDS).view(np.int64)
                total = np.bincount(doc, weights=count, minlength=len(new)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest[i] for i in new], type=pa.binary()), pa.array(total),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(new) + 1) * BANDS, type=pa.int32()), pa.array(keys.ravel()))],
                    names=["digest", "n", "bands"])
    return texts.select("digest", "text").mapInArrow(lean(sign), "digest binary, n long, bands array<bigint>")


def _once_per_task(texts: DataFrame) -> DataFrame:
    """(digest, text), each digest once per task, so that copies meet in as many rows as there are tasks at most."""
    def first(batches):
        seen = set()
        for batch in batches:
            new = []
            for i, x in enumerate(batch.column("digest").to_pylist()):
                if x not in seen:
                    seen.add(x)
                    new.append(i)
            if new:
                yield batch.take(pa.array(new))
    return texts.select("digest", "text").mapInArrow(lean(first), "digest binary, text string")


def _overlaps(a: "pa.Array", b: "pa.Array") -> np.ndarray:
    """Multiset Jaccard similarity of each pair of texts."""
    out = np.zeros(len(a))
    size = np.cumsum(pc.add(pc.binary_length(a), pc.binary_length(b)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(a):
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + VERIFY_BYTES, side="right")))
        sides = [(doc + x, run, count) for column in (a, b)
                 for x, _, data, offsets in text_chunks(column.slice(at, to - at))
                 for doc, run, count in [runs(data, offsets)]]
        pair, run, count = (np.concatenate(x) for x in zip(*sides))
        total = np.bincount(pair, weights=count, minlength=to - at)
        order = np.lexsort((run, pair))
        pair, run, count = pair[order], run[order], count[order]
        same = np.flatnonzero((pair[1:] == pair[:-1]) & (run[1:] == run[:-1]))
        both = np.bincount(pair[same], weights=np.minimum(count[same], count[same + 1]), minlength=to - at)
        out[at:to] = both / np.maximum(total - both, 1)
        at = to
    return out


def verified(pairs: DataFrame, texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) of digests whose texts are similar."""
    def check(batches):
        for batch in batches:
            ok = pa.array(_overlaps(batch.column("_a"), batch.column("_b")) >= similar - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])
    a = texts.select(F.col("digest").alias("a"), F.col("text").alias("_a"))
    b = texts.select(F.col("digest").alias("b"), F.col("text").alias("_b"))
    return (pairs.join(a, "a").join(b, "b").select("a", "b", "_a", "_b")
            .mapInArrow(lean(check), "a binary, b binary"))


def link_texts(texts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(digest, label) of the texts that share a bucket with another; equal labels: same class."""
    signed = materialise(band_table(texts), "bands")
    rows = signed.select("digest", "n", F.posexplode("bands").alias("band", "key"))
    rows = rows.select(F.xxhash64("band", "key").alias("bucket"), "digest", "n")
    crowded = (rows.groupBy("bucket").agg(F.min(F.struct("digest", "n")).alias("_main"), F.max("digest").alias("_other"))
               .where(F.col("_main.digest") != F.col("_other"))
               .select("bucket", F.col("_main.digest").alias("main"), F.col("_main.n").alias("main_n")))
    buckets = materialise(crowded, "buckets")
    members = materialise(rows.join(buckets, "bucket").select("bucket", "main", "main_n", "digest", "n").distinct(), "members")
    used = members.select("digest").distinct()
    near = materialise(_once_per_task(texts).join(used, "digest").groupBy("digest").agg(F.first("text").alias("text")), "near-texts")
    labels = materialise(used.withColumn("label", F.col("digest")), "labels")

    # one centre per bucket; two texts that share many buckets are compared once
    first = members.where((F.col("digest") != F.col("main")) & _fitting("n", "main_n", similar))
    pairs = materialise(first.select(F.col("main").alias("a"), F.col("digest").alias("b")).distinct(), "pairs")
    links = materialise(verified(pairs, near, similar), "links")
    labels = _merged(labels, links)

    # buckets whose members, the centre aside, are of several classes: their best linked members
    open_buckets = _open(members, labels)
    if open_buckets.isEmpty():
        return labels
    degree = links.select(F.explode(F.array("a", "b")).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("degree"))
    live = materialise(members.where("digest <> main").join(open_buckets, "bucket").join(labels, "digest"), "live")
    turn = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("degree").desc_nulls_last(), "digest"))
    hubs = live.join(degree, "digest", "left").withColumn("_turn", turn).where(F.col("_turn") <= HUBS)
    hubs = hubs.groupBy("bucket").agg(F.collect_list(F.struct(F.col("digest").alias("c"), F.col("n").alias("cn"), F.col("label").alias("cl"))).alias("hubs"))
    pairs = _hub_pairs(live, materialise(hubs, "centres"), pairs, similar)
    labels = _merged(labels, materialise(verified(pairs, near, similar), "links"))

    # what is still open: every pair that could be similar, by prefix filtering
    open_buckets = _open(members, labels)
    if open_buckets.isEmpty():
        return labels
    rest = materialise(members.join(open_buckets, "bucket").select("digest", "n").distinct().join(labels, "digest"), "rest")
    pairs = _prefix_pairs(near.join(rest.select("digest"), "digest"), rest, similar)
    return _merged(labels, materialise(verified(pairs, near, similar), "links"))


def _fitting(n, other, similar: float):
    """Sizes that do not rule out the similarity."""
    return F.least(n, other) >= F.greatest(n, other) * F.lit(similar)


def _hub_pairs(live: DataFrame, hubs: DataFrame, done: DataFrame, similar: float) -> DataFrame:
    """Members and hubs of their buckets that are of different classes and of fitting size, without the pairs
    ``done``. A bucket's hubs are one row with a short list (``HUBS``), and the lists of a text's buckets
    become one before pairs are made, so a text in all ``BANDS`` buckets of a group meets each hub once."""
    fits = F.filter("hubs", lambda h: (h.cl != F.col("label")) & _fitting("n", h.cn, similar))
    met = live.join(hubs, "bucket").select("digest", fits.alias("hubs"))
    met = met.groupBy("digest").agg(F.array_distinct(F.flatten(F.collect_list("hubs"))).alias("hubs"))
    met = met.select("digest", F.explode("hubs").alias("_hub")).select("digest", F.col("_hub.c").alias("c"))
    met = met.select(F.least("digest", "c").alias("a"), F.greatest("digest", "c").alias("b")).distinct()
    return materialise(met.join(done, ["a", "b"], "left_anti"), "pairs")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the links (a, b) of digests have joined their classes."""
    if links.isEmpty():
        return labels
    la, lb = (labels.select(F.col("digest").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    roots = components(links.join(la, "a").join(lb, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    moved = labels.join(roots, F.col("label") == F.col("node"), "left")
    return materialise(moved.select("digest", F.coalesce("root", "label").alias("label")), "labels")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Buckets with two members of different classes that are not its centre; all pairs with
    the centre have been compared."""
    found = (members.where("digest <> main").join(labels, "digest").groupBy("bucket")
             .agg(F.min("label").alias("_a"), F.max("label").alias("_z")).where("_a <> _z"))
    return materialise(found.select("bucket"), "open-buckets")


def _elements(data, offsets):
    """(text, element) of each text's multiset made a set: the k-th copy of a run is one element."""
    doc, run, count = runs(data, offsets)
    copy = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(doc, count), mix(np.repeat(run, count) + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _prefix_pairs(texts: DataFrame, rest: DataFrame, similar: float) -> DataFrame:
    """(a, b) of all texts of different classes that can reach the similarity. Exact: put the
    elements of all texts in one order, rare ones first; two sets with Jaccard similarity t
    share an element among the first n - ceil(t n) + 1 of each. A pair comes up at its first
    shared element if what follows in both is enough for the overlap it needs, and at a later
    one only if the ``WINDOW`` elements before it in both have none in common, so what is
    stored with an element does not grow with its text. The order comes from counts in SKETCH cells (a bounded
    table); an element alone in its cell is in one text only."""
    def count(batches):
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column("text")):
                got = np.bincount((_elements(data, offsets)[1] % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
                at = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(got[at].astype(np.int64))], names=["cell", "n"])

    table = texts.mapInArrow(lean(count), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()   # SKETCH rows at most
    sketch = np.zeros(SKETCH, dtype=np.int64)
    sketch[table["cell"].to_numpy()] = table["n"].to_numpy()
    shared = Shared(texts.sparkSession, sketch)

    def prefixes(batches):
        seen = shared.value
        for batch in batches:
            digest = batch.column("digest")
            for a, b, data, offsets in text_chunks(batch.column("text")):
                doc, element = _elements(data, offsets)
                rarity = seen[(element % np.uint64(SKETCH)).astype(np.int64)]
                order = np.lexsort((element, rarity, doc))
                doc, element, rarity = doc[order], element[order], rarity[order]
                n = np.bincount(doc, minlength=b - a)
                place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                keep = (place <= (n - np.ceil(similar * n - 1e-9).astype(np.int64))[doc]) & (rarity > 1)
                doc, place, value = doc[keep], place[keep], element[keep].view(np.int64)
                own = np.minimum(np.arange(len(doc)) - np.searchsorted(doc, doc), WINDOW)   # nearest earlier elements of the same text
                for x in range(0, len(doc), SLICE):
                    part = slice(x, x + SLICE)
                    n_own, end = own[part], np.cumsum(own[part])
                    at = np.repeat(np.arange(x, x + len(end)) - end, n_own) + np.arange(end[-1])
                    before = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]).astype(np.int32)), pa.array(value[at]))
                    yield pa.RecordBatch.from_arrays([digest.take(pa.array(a + doc[part])), pa.array(value[part]), pa.array(place[part].astype(np.int32)), before],
                                                     names=["digest", "element", "place", "before"])

    heads = texts.mapInArrow(lean(prefixes), "digest binary, element long, place int, before array<bigint>")
    heads = materialise(heads.join(rest, "digest"), "prefixes")
    sizes = heads.groupBy("element", "label").agg(F.count(F.lit(1)).alias("_n"))
    several = materialise(sizes.groupBy("element").agg(F.max(F.struct("_n", "label")).alias("_m"), F.count(F.lit(1)).alias("_k"))
                          .where("_k > 1").select("element", F.col("_m.label").alias("_most")), "shared-elements")
    right = materialise(heads.join(several, "element"), "prefixes")
    # one side leaves out the element's largest class, so a class is never paired with itself
    left = right.where("label <> _most").select("element", F.col("digest").alias("c"), F.col("n").alias("cn"), F.col("label").alias("cl"),
                                                F.col("place").alias("cplace"), F.col("before").alias("cbefore"))
    fits = _fitting("n", "cn", similar)
    enough = F.least(F.col("n") - F.col("place"), F.col("cn") - F.col("cplace")) >= (F.col("n") + F.col("cn")) * F.lit(similar / (1 + similar)) - 1e-6
    fresh = ~F.arrays_overlap("before", "cbefore")
    met = right.drop("_most").join(materialise(left, "prefixes"), "element").where((F.col("label") != F.col("cl")) & fits & enough & fresh)
    return materialise(met.select(F.least("digest", "c").alias("a"), F.greatest("digest", "c").alias("b")).distinct(), "pairs")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per document: doc_id, digest, class (a digest), class_id (the smallest id of
    its class) and class_size. Documents without words have no digest and class."""
    body = F.col(f"`{text}`")
    digest = F.when(body.rlike(WORD), F.unhex(F.md5(fold(body))))
    ids = materialise(docs.select(F.col(f"`{key}`").alias("doc_id"), digest.alias("digest")), "ids")
    labels = link_texts(digested(docs, key, text), similar)
    classed = ids.join(labels, "digest", "left").select("doc_id", "digest", F.coalesce("label", "digest").alias("class"))
    classed = materialise(classed, "classed")
    named = materialise(classed.where("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "classes")
    return classed.join(named, "class", "left").select(
        "doc_id", "digest", "class", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One document of each class stays, the one with the smallest id (then digest, then any
    of equal rows); documents without words all stay. Columns stay as they are."""
    found = materialise(near_duplicates(docs, key, text, similar), "near-dups")
    best = (found.where("digest is not null").groupBy("class", "class_id", "digest", "doc_id").agg(F.count(F.lit(1)).alias("_n"))
            .where("doc_id <=> class_id").groupBy("class", "class_id")
            .agg(F.min(F.struct("digest", "_n")).alias("_best")))
    best = materialise(best.select(F.col("class_id").alias("_id"), F.col("_best.digest").alias("_digest"), F.col("_best._n").alias("_n")), "kept")
    body = F.col(f"_row.`{text}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.withColumn("_d", F.when(body.rlike(WORD), F.unhex(F.md5(fold(body)))))
    kept = rows.where("_d is not null").join(best, (F.col("_d") == F.col("_digest")) & F.col(f"_row.`{key}`").eqNullSafe(F.col("_id")))
    out = kept.where("_n = 1").select("_row")
    if not best.where("_n > 1").isEmpty():
        repeated = kept.where("_n > 1").groupBy("_digest", "_id").agg(F.first("_row").alias("_row"))
        out = out.unionByName(repeated.select("_row"))
    return out.unionByName(rows.where("_d is null").select("_row")).select("_row.*")
