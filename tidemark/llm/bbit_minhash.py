"""Near-duplicate texts by b-bit MinHash.

A text is the set of its distinct lower-cased runs of letters and digits.  Minima
of ``bands * rows`` random permutations are taken over the words that are not
frequent in the collection; the minima of each band make one band key, and their
lowest bits are packed into a 64-bit signature.  Band entries travel as packed
blobs to the task that owns their key.  There, equal keys are candidates: the
bits in which two signatures differ, corrected for chance collisions, estimate
the similarity, and only candidates near the threshold go on to the exact check
on the whole word sets.

Why frequent words are left out of the minima: in a collection written from few
phrases, unrelated texts share a third of their words, and the pairs that collide
by those words grow with the square of the collection.  Words in more than
``frequent`` of the texts of a field are left out (there can be no more of them
than the mean number of words over ``frequent``, which bounds the broadcast list).
A text with little else keeps all its words in a second set of bands.
Similarity is always judged on all words.

Equal word sets are one class: they meet once per task, not in pairs, and are expanded last.  Tasks
that own keys are as many as their bytes ask for.  Keys so crowded that one task should not
hold them are told from a bounded sample of the texts before anything is gathered (the sample only
chooses the route, never the result): their entries are dealt into groups, and every two groups meet in
a task of their own.  A crowded key that the sample missed is cut into blocks, whose pairs
are spread over the cluster and compared there; nothing is dropped or capped.

Defined results
---------------
* Null and empty texts, and texts with fewer than ``least_words`` distinct words,
  are alike to none.  Texts of any length are used whole.
* Rows with a null id are left out; repeated rows change nothing; an id with two
  texts is alike to whatever either is alike to, never to itself.
* An empty table gives an empty result.  Extra columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import materialise, shuffle_partitions

WORD = re.compile(r"[^\W_]+")
#: A band entry on its way: within a part 32 bits tell keys apart (a chance meeting only costs a comparison).
_ENTRY = np.dtype([("key", "<u4"), ("text", "<u8"), ("sig", "<u8")])
#: The same packed to travel: of a text 48 bits, its code; texts that share one are told apart by the exact check.
_PACKED = np.dtype([("key", "<u4"), ("low", "<u4"), ("high", "<u2"), ("sig", "<u8")])
_CODE = (1 << 48) - 1
_FLUSH = 1_500_000  # entries held before they are handed on
#: Bytes of entries that one task gathers.
PART_BYTES = 16 << 20
#: Most classes of one key compared in one task; twice the size of the groups of a crowded key.
BLOCK = 32768
#: Texts whose keys are counted to tell crowded keys, and how often a key must occur among them.
SAMPLE, SEEN = 65536, 16


def words_of(text: str) -> set[str]:
    """The distinct lower-cased runs of letters and digits."""
    return set(WORD.findall(text.lower()))


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers (a bijection)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(words: list[str]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh32_intdigest
    return np.fromiter((digest(w) for w in words), np.uint32, count=len(words))


def sketches(df: DataFrame, id_col: str, text_cols: list[str], least_words: int) -> DataFrame:
    """``id``, ``field`` (place in ``text_cols``), ``text`` (hash of the word set), ``copy`` (hash of the text itself), ``words`` (sorted word hashes)."""
    import xxhash


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out_id, out_field, out_copy, out_words = [], [], [], []
            for field in range(len(text_cols)):
                for own, text in zip(ids, batch.column(1 + field).to_pylist(), strict=True):
                    if text:
                        words = words_of(text)
                        if len(words) >= least_words:
                            out_id.append(own)
                            out_field.append(field)
                            out_copy.append(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))
                            out_words.append(words)
            if len(known) > 1_000_000:
                known.clear()
            fresh = list(set().union(*out_words).difference(known))
            known.update(zip(fresh, _hash_words(fresh).tolist(), strict=True))
            offsets = np.zeros(len(out_words) + 1, np.int64)
            np.cumsum([len(w) for w in out_words], out=offsets[1:])
            look = known.__getitem__
            flat = np.fromiter((look(w) for words in out_words for w in words), np.uint32, count=int(offsets[-1]))
            group = np.repeat(np.arange(len(out_words), dtype=np.uint64), np.diff(offsets))
            flat = (np.sort(group << np.uint64(32) | flat) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            # the sum of scrambled words identifies the set, whatever its order
            scrambled = _mix(flat.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
            sums = np.add.reduceat(scrambled, offsets[:-1]) if len(out_words) else np.zeros(0, np.uint64)
            key = _mix(sums + np.array(out_field, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_id, pa.string()), pa.array(out_field, pa.int32()), pa.array(key.view(np.int64)), pa.array(np.array(out_copy, np.uint64).view(np.int64)), pa.ListArray.from_arrays(offsets.astype(np.int32), flat.view(np.int32))],
                names=["id", "field", "text", "copy", "words"],
            )

    rows = df.select(F.col(id_col).cast("string").alias("id"), *(F.col(c).cast("string") for c in text_cols)).where("id is not null")
    return rows.mapInArrow(run, "id string, field int, text long, copy long, words array<int>")


def frequent_words(sketch: DataFrame, share: float) -> list[tuple[int, int]]:
    """(field, word) of the words in more than ``share`` of a field's texts, counted over all of them."""
    total = sketch.groupBy("field").agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("w"))
    counts = sketch.select("field", F.explode("words").alias("word")).groupBy("field", "word").count()
    found = counts.join(F.broadcast(total), "field").where(F.col("count") > F.col("n") * share).select("field", "word")
    # at most (mean words per text) / share rows per field, whatever the size of the collection
    return [(r.field, r.word) for r in found.collect()]


class Bands:
    """Minima, band keys and packed low bits of word sets, for many texts at a time."""

    def __init__(self, bands: int, rows: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def minima(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The minimum of each permutation over each non-empty slice of ``flat``; one row per permutation."""
        spread = flat ^ (flat >> np.uint32(15))
        spread = spread * np.uint32(0x2C1B3C6D)
        spread ^= spread >> np.uint32(12)
        out = np.empty((len(self.a), len(starts)), np.uint32)
        for k in range(len(self.a)):
            hashed = spread * self.a[k] + self.b[k]
            hashed ^= hashed >> np.uint32(16)  # else the low bits are far from random
            hashed *= np.uint32(0x297A2D39)
            out[k] = np.minimum.reduceat(hashed, starts)
        return out

    def signature(self, minima: np.ndarray) -> np.ndarray:
        """The lowest bit of 64 minima, packed (b = 1)."""
        sig = np.zeros(minima.shape[1], np.uint64)
        step = max(1, len(minima) // 64)
        for bit, k in enumerate(range(0, min(len(minima), 64 * step), step)):
            sig |= (minima[k] & np.uint32(1)).astype(np.uint64) << np.uint64(bit)
        return sig

    def keys(self, minima: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The key of each band and text."""
        out = np.empty((self.bands, minima.shape[1]), np.uint64)
        for band in range(self.bands):
            key = salt + np.uint64(band * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            for row in minima[band * self.rows : (band + 1) * self.rows]:
                key = _mix(key + row)
            out[band] = key
        return out


def estimated_similarity(a: np.ndarray, b: np.ndarray, bits: int = 64) -> np.ndarray:
    """The similarity that equal low bits speak for: half of unequal minima agree in one bit by chance."""
    agree = 1 - np.bitwise_count(a ^ b) / bits
    return 2 * agree - 1


class Banded:
    """Band entries of batches of word sets; equal sets of a task count once."""

    def __init__(self, common: list[tuple[int, int]], bands: int, rows: int) -> None:
        self.maker, self.seen = Bands(bands, rows), set()
        self.frequent = {f: np.array(sorted(w for g, w in common if g == f), np.int32).view(np.uint32) for f in {f for f, _ in common}}

    def _bands(self, flat: np.ndarray, sizes: np.ndarray, text: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        full = sizes > 0
        starts = (np.cumsum(sizes) - sizes)[full]
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        minima = self.maker.minima(flat, starts)
        key = self.maker.keys(minima, salt[full])
        return key.ravel(), np.tile(text[full], self.maker.bands), np.tile(self.maker.signature(minima), self.maker.bands)

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, text and signature of each band of each text of a batch (field, text, words)."""
        field = batch.column(0).to_numpy()
        text = batch.column(1).to_numpy().view(np.uint64)
        lists = batch.column(2)
        flat = lists.flatten().to_numpy().view(np.uint32)
        sizes = np.diff(lists.offsets.to_numpy())
        first = np.zeros(len(text), bool)
        for k, own in enumerate(text.tolist()):
            if own not in self.seen:
                first[k] = True
                self.seen.add(own)
        if len(self.seen) > 3_000_000:
            self.seen.clear()
        flat, field, text, sizes = flat[np.repeat(first, sizes)], field[first], text[first], sizes[first]
        owner = np.repeat(np.arange(len(text)), sizes)
        rare = np.ones(len(flat), bool)
        for f, words in self.frequent.items():
            rare &= ~((field[owner] == f) & np.isin(flat, words))
        left = np.bincount(owner[rare], minlength=len(text))
        salt = _mix(field.astype(np.uint64) + np.uint64(1))
        made = [self._bands(flat[rare], left, text, salt)]
        poor = left < 0.4 * sizes  # few rare words: all words, in bands of their own
        if poor.any():
            made.append(self._bands(flat[poor[owner]], sizes[poor], text[poor], _mix(salt[poor] + np.uint64(99))))
        return tuple(np.concatenate([m[k] for m in made]) for k in range(3))


def crowded_keys(sketch: DataFrame, common: list[tuple[int, int]], bands: int, rows: int, n_texts: int, block: int, sample: int = SAMPLE, seen: int = SEEN) -> dict[int, int]:
    """Band keys that more than ``block`` texts are likely to have, with the number of groups to deal them into.

    At most ``2 * sample * bands / seen`` keys, whatever the size of the collection; the texts of the sample are chosen by their hash.
    """
    if n_texts <= block:  # no key can be crowded
        return {}
    share = min(1.0, sample / n_texts)
    some = sketch.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("field", "text", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        banded = Banded(common, bands, rows)
        for batch in batches:
            if batch.num_rows:
                key, n = np.unique(banded.of(batch)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    least = max(seen, int(block * share))
    found = some.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > least).collect()
    return {r.key & (1 << 64) - 1: max(2, -int(-r.n / share // (block // 2))) for r in found}


def _dealt(key: np.ndarray, text: np.ndarray, sig: np.ndarray, crowded: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of crowded keys go to every pair of groups that theirs is one of, under a key made for the pair."""
    keys, groups = crowded
    at = np.searchsorted(keys, key)
    at[at == len(keys)] = 0
    hot = keys[at] == key
    if not hot.any():
        return key, text, sig
    n = groups[at[hot]]
    own = np.repeat(text[hot] % n, n.astype(np.int64))
    other = (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n.astype(np.int64)).astype(np.int64)).astype(np.uint64)
    base = np.repeat(key[hot], n.astype(np.int64))
    pair = _mix(base + np.uint64(0x51ED270B) * (np.minimum(own, other) << np.uint64(32) | np.maximum(own, other)) + np.uint64(1))
    times = n.astype(np.int64)
    return np.concatenate([key[~hot], pair]), np.concatenate([text[~hot], np.repeat(text[hot], times)]), np.concatenate([sig[~hot], np.repeat(sig[hot], times)])


def _entries(sketch: DataFrame, common: list[tuple[int, int]], bands: int, rows: int, parts: int, crowded: dict[int, int]) -> DataFrame:
    """Packed band entries for the part that owns their key: ``part``, ``blob``."""
    hot = np.array(sorted(crowded), np.uint64)
    groups = np.array([crowded[k] for k in sorted(crowded)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        banded, held, owners, n = Banded(common, bands, rows), [], [], 0

        def hand_on() -> pa.RecordBatch:
            whole, part = np.concatenate(held), np.concatenate(owners)
            order = np.argsort(part, kind="stable")
            whole, part = whole[order], part[order]
            cuts = np.flatnonzero(np.diff(part)) + 1
            heads = part[np.concatenate([[0], cuts])]
            blobs = [x.tobytes() for x in np.split(whole, cuts)]
            return pa.RecordBatch.from_arrays([pa.array(heads.astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, text, sig = banded.of(batch)
            if len(hot):
                key, text, sig = _dealt(key, text, sig, (hot, groups))
            out = np.empty(len(key), _PACKED)
            out["key"], out["low"], out["high"], out["sig"] = key & np.uint64(0xFFFFFFFF), text & np.uint64(0xFFFFFFFF), (text >> np.uint64(32)) & np.uint64(0xFFFF), sig
            owners.append((key >> np.uint64(32)) % np.uint64(parts))
            held.append(out)
            n += len(out)
            if n > _FLUSH:
                yield hand_on()
                held.clear()
                owners.clear()
                n = 0
        if n:
            yield hand_on()

    return sketch.select("field", "text", "words").mapInArrow(run, "part int, blob binary")


def _compare_sorted(whole: np.ndarray, least: float, block: int, long: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Pairs of equal key and near signatures, in portions; runs longer than ``block`` are put into ``long`` instead."""
    order = np.lexsort((whole["text"], whole["key"]))
    whole = whole[order]
    fresh = np.ones(len(whole), bool)
    fresh[1:] = (whole["key"][1:] != whole["key"][:-1]) | (whole["text"][1:] != whole["text"][:-1])
    whole = whole[fresh]
    bounds = np.flatnonzero(np.concatenate([[True], whole["key"][1:] != whole["key"][:-1], [True]]))
    length = np.diff(bounds)
    long += [whole[int(bounds[i]) : int(bounds[i + 1])] for i in np.flatnonzero(length > block)]
    use = np.repeat((length > 1) & (length <= block), length)
    kept = whole[use]
    pairs, n, at = [], 0, np.arange(len(kept))
    step = 1
    while len(at):
        at = at[at + step < len(kept)]
        at = at[kept["key"][at] == kept["key"][at + step]]
        near = at[estimated_similarity(kept["sig"][at], kept["sig"][at + step]) >= least]
        if len(near):
            pairs.append(np.stack([kept["text"][near], kept["text"][near + step]], 1))
            n += len(near)
        if n > 500_000:
            yield pairs
            pairs, n = [], 0
        step += 1
    yield pairs


def _pair_batch(pairs: list[np.ndarray]) -> pa.RecordBatch:
    both = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.uint64)
    none = pa.nulls(len(both), pa.binary())
    a, b = np.minimum(both[:, 0], both[:, 1]), np.maximum(both[:, 0], both[:, 1])
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a).view(np.int64)), pa.array(np.ascontiguousarray(b).view(np.int64)), none, none], names=["text_a", "text_b", "left", "right"])


def candidates(sketch: DataFrame, bands: int, rows: int, frequent: float, least: float, block: int = BLOCK, sample: int = SAMPLE, seen: int = SEEN) -> DataFrame:
    """Distinct pairs of texts' codes (``code_a`` < ``code_b``) with an equal band key and near signatures."""
    n_texts, common = sketch.count(), frequent_words(sketch, frequent)
    crowded = crowded_keys(sketch, common, bands, rows, n_texts, block, sample, seen)
    n_entries = n_texts * bands + sum(n * n for n in crowded.values()) * (block // 2)
    parts = max(shuffle_partitions(sketch.sparkSession), -(-n_entries * _PACKED.itemsize // PART_BYTES))
    packed = _entries(sketch, common, bands, rows, parts, crowded)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(blob, _PACKED) for batch in batches for blob in batch.column(1).to_pylist()]
        if not held:
            return
        packed = np.concatenate(held)
        whole = np.empty(len(packed), _ENTRY)
        whole["key"], whole["sig"], whole["text"] = packed["key"], packed["sig"], packed["high"].astype(np.uint64) << np.uint64(32) | packed["low"]
        long: list[np.ndarray] = []
        for pairs in _compare_sorted(whole, least, block, long):
            yield _pair_batch(pairs)
        for run in long:  # a crowded key: every pair of its blocks becomes a task of the next stage
            cut = [run[i : i + block] for i in range(0, len(run), block)]
            for i, left in enumerate(cut):
                blobs = [x.tobytes() for x in cut[i:]]
                none = pa.nulls(len(blobs), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array([left.tobytes()] * len(blobs), pa.binary()), pa.array(blobs, pa.binary())], names=["text_a", "text_b", "left", "right"])

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = np.frombuffer(left, _ENTRY), np.frombuffer(right, _ENTRY)
                pairs = []
                for shift in range(len(b)):
                    m = min(len(a), len(b) - shift)
                    forward = estimated_similarity(a["sig"][:m], b["sig"][shift : shift + m]) >= least
                    pairs.append(np.stack([a["text"][:m][forward], b["text"][shift : shift + m][forward]], 1))
                for shift in range(1, len(a)):
                    m = min(len(b), len(a) - shift)
                    forward = estimated_similarity(a["sig"][shift : shift + m], b["sig"][:m]) >= least
                    pairs.append(np.stack([a["text"][shift : shift + m][forward], b["text"][:m][forward]], 1))
                both = np.concatenate(pairs)
                yield _pair_batch([both[both[:, 0] != both[:, 1]]])

    schema = "text_a long, text_b long, left binary, right binary"
    met = materialise(packed.repartitionById(parts, F.col("part")).mapInArrow(join, schema))
    crowded = met.where("left is not null").select("left", "right").repartition(parts).mapInArrow(cross, schema)
    return met.where("left is null").unionByName(crowded).select(F.col("text_a").alias("code_a"), F.col("text_b").alias("code_b")).distinct()


def alike_texts(sketch: DataFrame, threshold: float, bands: int, rows: int, frequent: float) -> DataFrame:
    """Pairs of different texts whose word sets are alike, with ``similarity``; exact, from the candidates."""
    # the signature's standard deviation at the threshold is below 0.12: 0.36 under it loses one pair in a thousand
    near = materialise(candidates(sketch, bands, rows, frequent, threshold - 0.36))
    code = F.col("text").bitwiseAND(_CODE)
    met = near.select(F.col("code_a").alias("code")).unionByName(near.select(F.col("code_b").alias("code"))).distinct()
    sets = sketch.select(code.alias("code"), "text", "words").join(met, "code", "left_semi").groupBy("text").agg(F.first("words").alias("words")).withColumn("code", code)
    one = near.join(sets.select(F.col("code").alias("code_a"), F.col("text").alias("text_a"), F.col("words").alias("words_a")), "code_a")
    two = one.join(sets.select(F.col("code").alias("code_b"), F.col("text").alias("text_b"), F.col("words").alias("words_b")), "code_b")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    judged = two.select("text_a", "text_b", shared.alias("shared"), (F.size("words_a") + F.size("words_b") - shared).alias("either"))
    return judged.where(F.col("shared") >= F.col("either") * threshold - 1e-9).select("text_a", "text_b", (F.col("shared") / F.col("either")).alias("similarity"))


def near_duplicates(
    df: DataFrame, id_col: str = "id", text_cols: tuple[str, ...] = ("content", "summary"), threshold: float = 0.7, least_words: int = 12, bands: int = 32, rows: int = 4, frequent: float = 0.15, expand: int = 1000
) -> DataFrame:
    """``id_a`` < ``id_b`` of every two ids with alike texts in the same field.

    Pairs of classes of equal word sets come from :func:`alike_texts`; they, and the members
    of a class, are expanded to ids here because every pair is asked for.  Only exact copies
    of one text, where there are more than ``expand`` of them, are not: each is paired with
    the smallest id among them, which also stands for them in pairs with other texts
    (``text_classes`` has the members), so copies of a third of all rows give no square of them.
    """
    sketch = materialise(sketches(df, id_col, list(text_cols), least_words))
    alike = materialise(alike_texts(sketch, threshold, bands, rows, frequent).select("text_a", "text_b"))
    members = sketch.select("id", "text", "copy")
    return expand_classes(members, ["text"], alike, expand)


def expand_classes(members: DataFrame, key: list[str], alike: DataFrame, expand: int) -> DataFrame:
    """``id_a`` < ``id_b`` from pairs of classes (key columns with _a and _b) and the members (``id``, key and ``copy``) of each class.

    Most texts are like no other: members of classes with a pair or a second member are kept first, and written once.
    """
    repeated = members.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    ends = [alike.select(*(F.col(f"{k}_{side}").alias(k) for k in key)) for side in "ab"]
    asked = repeated.unionByName(ends[0]).unionByName(ends[1]).distinct()
    sized = materialise(standing_ids(materialise(members.join(asked, key, "left_semi").distinct()), key, expand))
    standing = materialise(sized.where("stands").select("id", *key).distinct())
    classes = standing.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    one, two = (standing.select(F.col("id").alias(name), *(F.col(k).alias(f"{k}_{side}") for k in key)) for name, side in (("one", "a"), ("two", "b")))
    equal = classes.select(*(F.col(k).alias(f"{k}_{side}") for side in "ab" for k in key))
    pairs = alike.unionByName(equal).join(one, [f"{k}_a" for k in key]).join(two, [f"{k}_b" for k in key]).where("one <> two").select("one", "two")
    copies = sized.where("not stands").select(F.col("first").alias("one"), F.col("id").alias("two"))
    return pairs.unionByName(copies).select(F.least("one", "two").alias("id_a"), F.greatest("one", "two").alias("id_b")).distinct()


def standing_ids(members: DataFrame, key: list[str], expand: int) -> DataFrame:
    """The members with ``stands`` (false for the copies of one text beyond ``expand``, the smallest id aside) and that ``first`` id."""
    large = members.groupBy(*key, "copy").agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") > expand)
    sized = members.join(large, [*key, "copy"], "left")
    return sized.withColumn("stands", F.col("n").isNull() | (F.col("id") == F.col("first"))).drop("n", "copy")


def text_classes(
    df: DataFrame, id_col: str = "id", text_cols: tuple[str, ...] = ("content", "summary"), threshold: float = 0.7, least_words: int = 12, bands: int = 32, rows: int = 4, frequent: float = 0.15
) -> DataFrame:
    """One row per id and field: ``id``, ``field``, ``class_id`` (the texts with equal words), ``copies``, ``links`` to other classes."""
    sketch = materialise(sketches(df, id_col, list(text_cols), least_words))
    alike = alike_texts(sketch, threshold, bands, rows, frequent)
    ends = alike.select(F.col("text_a").alias("text")).unionByName(alike.select(F.col("text_b").alias("text")))
    links = ends.groupBy("text").agg(F.count("*").alias("links"))
    members = sketch.select("id", "field", "text").distinct()
    size = members.groupBy("text").agg(F.count("*").alias("copies"))
    names = F.element_at(F.array(*(F.lit(c) for c in text_cols)), F.col("field") + 1)
    joined = members.join(size, "text").join(links, "text", "left")
    return joined.select("id", names.alias("field"), F.col("text").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
