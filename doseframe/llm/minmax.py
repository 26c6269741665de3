"""Near duplicates by min-max hashing: every permutation gives two signature values, its minimum and its maximum.

Both agree between two sets with the probability of their similarity, so a signature needs half the hash
evaluations, and their errors partly cancel. Bands of values propose pairs, full sets decide.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from doseframe.llm.components import components, merged
from doseframe.llm.sieve import sieve
from doseframe.llm.text import byte_groups, unused
from doseframe.session import staged

# 48 bands of 6 values (3 permutations): a pair of similarity 0.8 is missed with a chance of 5e-7.
BANDS, PER_BAND = 48, 3
# Bytes kept of a shingle's hash for the comparison of full sets.
KEPT_BYTES = 6
SALTS = 16
# Pivots, besides the first in a hash order, that a class is compared with.
PIVOTS = 4
# Pairs of a bucket whose signatures agree less than this many standard deviations below the similarity are
# not worth a comparison of full sets (2.3e-6 of the pairs at the threshold with 72 values, 1.2e-6 with 288).
DEVIATIONS = 5.0
# Members that are compared in one block at most; rows and bytes of small groups that share a task.
BLOCK, GROUP_ROWS, GROUP_BYTES = 512, 1_000, 8 << 20
# Shingles hashed at once, and bytes of text at once (bounds memory for very long texts).
CHUNK, TEXT_CHUNK = 512, 1 << 20
# Bytes of texts that are sketched, or made sets of, before they are given on.
TEXTS_AT_ONCE = 2 << 20
BLANKS = b" \t\n\x0b\x0c\r"
BLANK = re.compile(b"[ \\t-\\r]")


class Sketcher:
    """Shingle sets and band keys of texts."""

    def __init__(self, shingle: int, bands: int = BANDS, per_band: int = PER_BAND, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.shingle, self.bands = shingle, bands
        self.odd = (rng.integers(0, 2**32, bands * per_band, dtype=np.uint32) | np.uint32(1))[:, None]
        self.flip = rng.integers(0, 2**32, bands * per_band, dtype=np.uint32)[:, None]
        self.mix = rng.integers(0, 2**63, 2 * per_band, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.place = rng.integers(0, 2**63, bands, dtype=np.uint64)
        self.step = rng.integers(0, 2**63, max(1, shingle), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        # Hash of a word: sum of random values of its bytes times powers of an odd number, modulo 2**64.
        values = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        values[65:91] = values[97:123]
        self.values, self.base = values, int(rng.integers(2**62, 2**63)) | 1
        self.ink = np.ones(256, dtype=np.int8)
        self.ink[list(BLANKS)] = 0
        self.power = self.inverse = np.empty(0, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, 1 << 16)
            for name, base in (("power", self.base), ("inverse", pow(self.base, -1, 2**64))):
                table = np.full(size, np.uint64(base), dtype=np.uint64)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))

    def hashes(self, data: bytes) -> np.ndarray:
        """A hash for each word of `data`."""
        raw = np.frombuffer(data, dtype=np.uint8)
        edge = np.diff(self.ink[raw], prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self._powers(len(raw))
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.values[raw] * self.power[:len(raw)], out=total[1:])
        return _scramble((total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def word_hashes(self, text: str | None) -> np.ndarray:
        """The same over a text of any length, cut at blanks."""
        data = b"" if text is None else text.encode("utf-8", "surrogatepass")
        parts, start = [], 0
        while len(data) - start > TEXT_CHUNK:
            blank = BLANK.search(data, start + TEXT_CHUNK)
            if blank is None:
                break
            parts.append(self.hashes(data[start:blank.start()]))
            start = blank.start()
        parts.append(self.hashes(data[start:]))
        return np.concatenate(parts)

    def set_of(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of runs of `shingle` words; of all words where there are fewer."""
        h = self.word_hashes(text)
        if not len(h):
            return h
        k = min(self.shingle, len(h))
        n = len(h) - k + 1
        total = np.full(n, np.uint64(len(h) if len(h) < self.shingle else self.shingle) << np.uint64(7), dtype=np.uint64)
        for i in range(k):
            total = _scramble(total ^ (h[i:i + n] * self.step[i]))
        total.sort()
        return total[np.concatenate(([True], total[1:] != total[:-1]))]

    def bands_of(self, kinds: np.ndarray) -> tuple[np.ndarray, bytes]:
        """One 64-bit key for each band of the signature (minimum and maximum under each permutation), and
        one byte of a hash of each signature value."""
        x = (kinds >> np.uint64(32)).astype(np.uint32)
        low = high = None
        for start in range(0, len(x), CHUNK):
            y = (x[None, start:start + CHUNK] ^ self.flip) * self.odd
            a, b = y.min(axis=1), y.max(axis=1)
            low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
        rows = np.concatenate((low.reshape(self.bands, -1), high.reshape(self.bands, -1)), axis=1).astype(np.uint64)
        key = self.place.copy()
        for i in range(rows.shape[1]):
            key = _scramble(key ^ (rows[:, i] * self.mix[i]))
        return key, (_scramble(rows.ravel()) >> np.uint64(56)).astype(np.uint8).tobytes()


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def packed(kinds: np.ndarray) -> bytes:
    """The kept bytes of sorted hashes, one after the other."""
    top = (kinds >> np.uint64(64 - 8 * KEPT_BYTES)).astype("<u8")
    return top.view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, KEPT_BYTES)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :KEPT_BYTES] = raw
    return out.view("<u8").ravel()


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(a) else 0


def sketch_column(text: Column, shingle: int) -> Column:
    """Struct n, digest (of the full set), bands; null digest and no bands for empty sets."""
    @F.arrow_udf("n long, digest binary, bands array<long>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        make = Sketcher(shingle)
        for texts in _few(batches):
            rows = []
            for t in texts:
                kinds = make.set_of(t)
                if len(kinds):
                    digest = hashlib.blake2b(kinds.tobytes(), digest_size=16).digest()
                    rows.append((len(kinds), digest, make.bands_of(kinds)[0].view(np.int64)))
                else:
                    rows.append((0, None, None))
            n, digests, bands = zip(*rows)
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["n", "digest", "bands"]
            )

    return sketch(text)


def set_column(text: Column, shingle: int) -> Column:
    """Struct signature (a byte for each value) and kinds (packed set)."""
    @F.arrow_udf("signature binary, kinds binary")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        make = Sketcher(shingle)
        for texts in _few(batches):
            rows = []
            for t in texts:  # one full set at a time
                kinds = make.set_of(t)
                rows.append((make.bands_of(kinds)[1], packed(kinds)) if len(kinds) else (b"", b""))
            yield pa.StructArray.from_arrays([pa.array(x, pa.binary()) for x in zip(*rows)], ["signature", "kinds"])

    return sets(text)


def _few(batches: Iterator[pa.Array]) -> Iterator[list[str | None]]:
    """Texts of some batches, at most TEXTS_AT_ONCE bytes or one text at a time."""
    for texts in batches:
        for part in byte_groups(pa.record_batch([texts], ["text"]), 0, TEXTS_AT_ONCE):
            yield part.column(0).to_pylist()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; sets has (class, n, kinds)."""
    @F.arrow_udf("boolean")
    def near(x: pa.Array, y: pa.Array) -> pa.Array:
        out, last, left = [], None, None
        for p, q in zip(x, y):   # sets are read where they lie
            p = p.as_buffer()
            if last is None or not p.equals(last):
                last, left = p, unpacked(p)
            right = unpacked(q.as_buffer())
            common = shared(left, right)
            out.append(100 * common >= percent * (len(left) + len(right) - common))
        return pa.array(out, pa.bool_())

    # A pivot (b) with very many pairs is sent once for each salt that its pairs have, never once for all.
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    a = pairs.join(sets.select(F.col("class").alias("a"), F.col("kinds").alias("x")), "a")
    b = pairs.select("b", "salt").distinct().join(sets.select(F.col("class").alias("b"), F.col("kinds").alias("y")), "b")
    return a.join(b, ["b", "salt"]).where(near("y", "x")).select("a", "b")


def _least_agreeing(values: int, percent: int) -> float:
    return values * percent / 100 - DEVIATIONS * np.sqrt(values * percent * (100 - percent)) / 100


def _across(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between parts that share a bucket.

    Buckets with the same smallest class are taken together, so that a group of copies, which shares many
    buckets, is sent once and not once for every band. The largest part of a group needs no comparison within
    itself: it is cut into blocks by a hash, the other members into blocks of their own, and each block of
    others meets every block. Sizes and signatures rule most pairs out, full sets decide. A task joins the parts
    of a block as it goes, so that it compares no members already joined and gives fewer links than parts.
    """
    leads = apart.groupBy("band").agg(F.min("class").alias("lead"))
    found = apart.join(leads, "band").select("lead", "class", "n", "part").distinct()
    sizes = found.groupBy("lead", "part").agg(F.count("*").alias("members")).groupBy("lead").agg(
        F.max(F.struct("members", "part")).alias("main"), F.sum("members").alias("all")
    )
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    sizes = sizes.select(
        "lead", F.col("main.part").alias("main"), blocks(F.col("main.members")).alias("mains"),
        blocks(F.col("all") - F.col("main.members")).alias("others"),
    ).where("others > 0")
    cut = found.join(sizes, "lead").withColumn("major", F.col("part") == F.col("main"))
    place = F.xxhash64("class")
    # Blocks of others come first, those of the largest part after them.
    cut = cut.withColumn("mine", F.when(F.col("major"), F.col("others") + F.pmod(place, "mains")).otherwise(F.pmod(place, "others")).cast("int"))
    last = F.when(F.col("major"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    cut = cut.select("lead", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "class", "n", "part")
    cut = staged(cut.join(sets, "class"), "blocks")
    amount = cut.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("kinds")), F.lit(0)).alias("bytes")).first()
    groups = amount["n"] // GROUP_ROWS + amount["bytes"] // GROUP_BYTES + 1
    cut = cut.withColumn("group", F.pmod(F.xxhash64("lead", "i", "j"), F.lit(groups)))

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        out = set()
        for (_, i, j), rows in pdf.groupby(["lead", "i", "j"], sort=False):
            sig = np.frombuffer(b"".join(rows["signature"]), dtype=np.uint8).reshape(len(rows), -1)
            n, part, mine = rows["n"].to_numpy(), rows["part"].to_numpy().copy(), rows["mine"].to_numpy()
            kinds = [None] * len(rows)
            packs = list(rows["kinds"])
            # A first look at a part of the signature drops most pairs.
            looks = [(s, _least_agreeing(s.shape[1], percent)) for s in (np.ascontiguousarray(sig[:, ::4]), sig)]
            for k in range(len(rows) - 1):
                others = np.arange(k + 1, len(rows))
                fit = (part[others] != part[k]) & (np.minimum(n[others], n[k]) * 100 >= np.maximum(n[others], n[k]) * percent)
                others = others[fit & (mine[others] != mine[k])] if i != j else others[fit]
                for s, least in looks:
                    others = others[np.count_nonzero(s[others] == s[k], axis=1) >= least]
                for o in others:
                    low, high = sorted((int(part[k]), int(part[o])))
                    if low == high:
                        continue
                    for x in (k, o):
                        if kinds[x] is None:
                            kinds[x] = unpacked(packs[x])
                    common = shared(kinds[k], kinds[o])
                    if 100 * common >= percent * (len(kinds[k]) + len(kinds[o]) - common):
                        out.add((high, low))
                        part[part == high] = low
        return pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")

    return cut.groupBy("group").applyInPandas(links, "a long, b long").distinct()


def near_duplicates(df: DataFrame, key: str, text: str, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `df`: the key, n_shingles, component_id, kept, first, text_hash.

    Words are runs of anything but space and the control characters 9 to 13, with A-Z lowered; a text's
    set holds its distinct runs of `shingle` words, or all its words as one where there are fewer. Texts
    without words and null texts have an empty set and no links. Two rows are linked when
    100 * intersection >= percent * union; component_id is the smallest key reachable over links (itself
    included), kept says that the row's key is that one, and `first` marks one single row of a component
    even where keys repeat. Null keys count as larger than any. Other columns of `df` are not read.

    Rows with equal sets become one class before anything is compared, so exact copies never meet in
    pairs. Classes that share a bucket of a band are joined in two rounds: every class with a few pivots of
    its buckets; then, in buckets that still hold several parts, all members of different parts, in blocks, which
    keeps every link between texts that share a bucket. Only a few links a class, and then links between parts,
    reach the components.
    """
    rows = df.select(
        F.col(key).alias("key"), text_hash(F.col(text)).alias("text_hash"), sketch_column(F.col(text), shingle).alias("s"),
        F.monotonically_increasing_id().alias("rid"),
    )
    rows = staged(rows.select("key", "text_hash", "rid", "s.n", "s.digest", "s.bands"), "sketches")

    # A class is named by the row id of its first row: by key, then by row.
    order = F.struct(F.col("key").isNull(), "key", "rid", "text_hash")
    classes = staged(rows.where("digest is not null").groupBy("digest").agg(
        F.min(order).alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies"),
    ).select(
        F.col("least.rid").alias("class"), F.col("least.key").alias("key"), F.col("least.text_hash").alias("text_hash"),
        "digest", "n", "bands", "copies",
    ), "classes")

    # Only keys are shuffled to find the bands that classes share; a sieve spares most others the join.
    members = classes.select("class", "n", F.explode("bands").alias("band"))
    common = staged(members.groupBy("band").agg(F.count("*").alias("m")).where("m > 1").select("band"), "common")
    members = staged(members.where(sieve(common)(F.col("band"))).join(common, "band"), "members")
    tops = members.groupBy("band").agg(F.min(F.struct(F.xxhash64("class").alias("turn"), "class", "n")).alias("t"))
    tops = tops.select("band", F.col("t.class").alias("top"), F.col("t.n").alias("top_n"), F.col("t.turn").alias("top_turn"))
    buckets = staged(members.join(tops, "band"), "buckets")

    # Full sets are made of the texts whose class shares a band at all, and only those texts are moved.
    wanted = classes.join(buckets.select("class").distinct(), "class", "left_semi").select("class", F.col("key").alias("_key"), F.col("text_hash").alias("_hash"))
    wanted = staged(wanted, "wanted")
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text"), text_hash(F.col(text)).alias("text_hash"))
    texts = texts.where(sieve(wanted.select(F.xxhash64("_key", "_hash")))(F.xxhash64("key", "text_hash")))
    texts = texts.join(wanted, F.col("key").eqNullSafe(F.col("_key")) & (F.col("text_hash") == F.col("_hash")))
    sets = texts.select("class", set_column(F.col("text"), shingle).alias("s")).groupBy("class").agg(F.first("s").alias("s"))
    sets = staged(sets.select("class", "s.signature", "s.kinds"), "sets")
    star = _sizes_fit(buckets.where("class <> top"), "n", "top_n", percent)
    # A class has at most one pivot a band: of these the one that comes first in the hash order, and those that share most bands.
    often = star.groupBy("class", "top").agg(F.count("*").alias("c"), F.first("top_turn").alias("turn")).groupBy("class").agg(
        F.min(F.struct("turn", "top"))["top"].alias("least"), F.sort_array(F.collect_list(F.struct("c", "top")), False)["top"].alias("most")
    )
    pivots = F.array_union(F.array("least"), F.slice("most", 1, PIVOTS))
    first = often.select(F.col("class").alias("a"), F.explode(pivots).alias("b"))
    labels = components(staged(_confirmed(first, sets, percent), "links"))

    # Buckets whose members are still in several parts.
    part = F.coalesce("label", "class")
    apart = buckets.join(labels.withColumnRenamed("node", "class"), "class", "left").select("band", "class", "n", part.alias("part"))
    mixed = apart.groupBy("band").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("band")
    apart = staged(apart.join(mixed, "band", "left_semi"), "apart")
    labels = merged(labels, _across(apart, sets, percent))

    # Smallest key of each component, then back to the rows through the classes that need it.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    joined = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").select("digest", "class", "key", "copies", "label")
    lows = joined.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("key").isNull(), "key", "class")).alias("low"))
    joined = joined.where("label is not null or copies > 1").withColumn("salt", F.pmod("class", F.lit(SALTS)).cast("int"))
    joined = joined.join(lows.select("label", "low", salts), ["label", "salt"], "left")
    placed = joined.select(
        "digest", F.when(F.col("low").isNull(), F.col("key")).otherwise(F.col("low.key")).alias("component_id"),
        F.coalesce("low.class", "class").alias("head"), salts,
    )
    thin = rows.select("key", "text_hash", "rid", "n", "digest", F.pmod("rid", F.lit(SALTS)).cast("int").alias("salt"))
    out = thin.join(placed, ["digest", "salt"], "left")
    component = F.when(F.col("head").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("key").eqNullSafe(component).alias("kept"), (F.col("head").isNull() | (F.col("head") == F.col("rid"))).alias("first"),
        "text_hash",
    )


def keep_one(df: DataFrame, key: str, text: str, shingle: int = 5, percent: int = 80) -> DataFrame:
    """`df` with one row of each component of `near_duplicates`: the one with the smallest key. Rows with an
    empty set all stay. Columns are those of `df`; of rows that repeat key and text one stays.

    The texts are moved once, to be joined with the keys and text hashes of the rows that go.
    """
    found = staged(near_duplicates(df, key, text, shingle, percent), "found")
    # Columns of `df` keep their names and values, whatever they are called.
    key_name, hash_name = unused(df, "_key"), unused(df, "_hash")
    rows = found.groupBy(F.col(key).alias(key_name), F.col("text_hash").alias(hash_name)).agg(
        F.max("first").alias("stays"), F.count("*").alias("n"), F.max("n_shingles").alias("size")
    )
    marked = df.withColumn(hash_name, text_hash(F.col(text)))

    def same(other: DataFrame):
        return marked[key].eqNullSafe(other[key_name]) & (marked[hash_name] == other[hash_name])

    gone = staged(rows.where(~F.col("stays")).select(key_name, hash_name), "gone")
    again = staged(rows.where(F.col("stays") & (F.col("n") > 1) & (F.col("size") > 0)).select(key_name, hash_name), "again")
    touched = gone.unionByName(again)
    may_go = F.coalesce(sieve(touched.select(F.xxhash64(key_name, hash_name)))(F.xxhash64(F.col(key), F.col(hash_name))), F.lit(False))
    out = marked.where(~may_go).unionByName(marked.where(may_go).join(touched, same(touched), "left_anti")).drop(hash_name)
    if again.isEmpty():
        return out
    rest = [c for c in df.columns if c not in (key, text)]
    extra = marked.where(may_go).join(again, same(again), "left_semi").drop(hash_name)
    row = unused(df, "_row")
    one = extra.groupBy(key, text).agg(F.min(F.struct(F.lit(0), *rest)).alias(row))
    return out.unionByName(one.select(*[F.col(row)[c].alias(c) if c in rest else F.col(c) for c in df.columns]))


def text_hash(text: Column) -> Column:
    """Two hashes and the length of a text as one string; the same for null and empty texts."""
    text = F.coalesce(text, F.lit(""))
    return F.concat_ws("/", F.xxhash64(text), F.crc32(text.cast("binary")), F.length(text))


def _sizes_fit(pairs: DataFrame, a: str, b: str, percent: int) -> DataFrame:
    """Pairs whose set sizes allow the similarity at all: the smaller is at most the intersection."""
    return pairs.where(F.least(a, b) * 100 >= F.greatest(a, b) * percent)
