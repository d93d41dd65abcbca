"""Near-duplicate documents by HyperMinHash.

A text's set is that of its distinct shingles of ``shingle_words`` words, lower-cased in A-Z; a text with
fewer words is one shingle.  The sketch cuts the shingles' 64-bit hashes into 128 buckets by their
top bits and keeps of each bucket's least hash a 16-bit register: the count of leading zeros
and the 10 bits that follow.  Empty buckets are registers too: they agree where both are empty.

* Rows with equal sets (128-bit fingerprint of the whole set) are one class, merged before the shuffle.
* 32 bands of 4 registers propose links between classes of 20 shingles and more.  A shingle that
  differs spoils one band at most, so the chance that none of the bands agrees is under 1e-6.
* Smaller sets take an exact way: their keys are their least hashes, as many as a linked set can lack
  and one more, so two linked sets share a key always (sets of up to 20 / threshold have these too).
* Buckets are split by set size, since only sets of like size can be linked, and small ones are
  thinned on registers alone; only what is left has its full sets made.
* In a bucket all members are first compared with its smallest member only; what that leaves apart
  is compared in blocks, inside tasks, pair by pair.  Pairs pass the collision-corrected Jaccard
  estimate of their registers, five deviations wide, and are then verified on full sets.
* Links join into components; each class, and each row of it, has the smallest doc_id reachable.

Tasks return at most as many links as they have members (a spanning forest), so a group of
thousands of near copies never becomes all its pairs.

Defined results: null texts and texts without words have empty sets and link with nothing; rows with a
null doc_id are left alone (component null, kept); rows that share a doc_id are one node, whose texts
all count; very long texts are
sketched whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .scratch import Scratch
from .textwords import byte_codes, chunks, hashes, mix, one_batch, sequence_hashes, spans

BUCKET_BITS, MANTISSA_BITS = 7, 10
BUCKETS = 1 << BUCKET_BITS
BANDS = 32
#: Sets of fewer shingles are found by their least hashes, not by bands.
FEW = 20
#: From the HyperMinHash paper: expected accidental register matches of two large equal sets are so many times buckets / 2**mantissa.
COLLISIONS = 0.169919487159739
BLOCK = 4096
#: A block holds about so many shingles at most, or one set.
BLOCK_SHINGLES = 1 << 22
#: Buckets up to this size are compared on registers before any set is made.
SMALL = 64


def shingle_sets(raw: np.ndarray, at: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of each row, in order."""
    start, end, row = spans(raw, at)
    word = hashes(raw, start, end, codes)
    gram = sequence_hashes(word, n)
    whole = row[: len(gram)] == row[n - 1 :] if len(gram) else np.zeros(0, bool)
    owner, value = row[: len(gram)][whole], gram[whole]
    count = np.bincount(row, minlength=len(at) - 1)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(row, short)
        brief = mix(np.array([np.bitwise_xor.reduce(mix(word[f : f + count[r]] + np.arange(1, count[r] + 1, dtype=np.uint64))) for f, r in zip(first, short, strict=True)], dtype=np.uint64))
        owner, value = np.append(owner, short), np.append(value, brief)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def registers(owner: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """rows x BUCKETS registers: 0 for an empty bucket, else 1 + (leading zeros, mantissa) of its least hash."""
    out = np.zeros((rows, BUCKETS), np.uint16)
    if not len(value):
        return out
    bucket = (value >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    cell = owner * BUCKETS + bucket
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    least = (value[first] << np.uint64(BUCKET_BITS)) | np.uint64(1 << (BUCKET_BITS - 1))
    _, exponent = np.frexp((least >> np.uint64(11)).astype(np.float64))
    zeros = (53 - exponent).astype(np.uint64)
    mantissa = ((least << zeros) >> np.uint64(63 - MANTISSA_BITS)) & np.uint64((1 << MANTISSA_BITS) - 1)
    out.reshape(-1)[cell[first]] = (np.uint64(1) + (zeros << np.uint64(MANTISSA_BITS)) + mantissa).astype(np.uint16)
    return out


def band_keys(regs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """rows x BANDS keys, 0 where a row does not have the band."""
    words = np.ascontiguousarray(regs).view(np.uint64).reshape(len(regs), BANDS)
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    return np.where((words != 0) & (n >= FEW)[:, None], mix(words + salt), np.uint64(0))


def least_hashes(owner: np.ndarray, value: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the (sorted) shingles are keys of small sets, and how many each row has: in one order
    of all shingles, two sets that share so many have one among the first n - ceil(share * n) + 1."""
    count = np.where(100 * n < 100 * 100 * FEW // percent + 100, n - -(-percent * n // 100) + 1, 0)
    count = np.where(n > 0, count, 0)
    first = np.append(0, np.cumsum(n)[:-1])
    return np.flatnonzero(np.arange(len(owner)) - first[owner] < count[owner]), count


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the estimated Jaccard similarity of register rows, corrected for accidental matches,
    and the sizes allow ``threshold``; five standard deviations wide."""
    hits = ((a == b) & (a != 0)).sum(axis=-1)
    filled = np.maximum(((a | b) != 0).sum(axis=-1), 1)
    ratio = na / nb
    chance = COLLISIONS * BUCKETS / 2**MANTISSA_BITS * 4 * ratio / (1 + ratio) ** 2
    estimate = (hits - chance) / filled
    slack = 5 * np.sqrt(threshold * (1 - threshold) / filled)
    return (estimate >= threshold - slack) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9)


def thin(regs: np.ndarray) -> np.ndarray:
    """rows x 64 bytes: 4 bits of each register (0 where it is empty), enough to tell most unlike pairs apart."""
    code = np.where(regs == 0, np.uint8(0), (mix(regs.astype(np.uint64)) % np.uint64(15)).astype(np.uint8) + np.uint8(1))
    return code[:, 0::2] | (code[:, 1::2] << np.uint8(4))


def thin_plausible(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """As ``plausible``, on thin registers, of which one in 15 agrees by accident."""
    low_a, low_b, high_a, high_b = a & 15, b & 15, a >> 4, b >> 4
    hits = ((low_a == low_b) & (low_a != 0)).sum(axis=1) + ((high_a == high_b) & (high_a != 0)).sum(axis=1)
    filled = np.maximum(((low_a | low_b) != 0).sum(axis=1) + ((high_a | high_b) != 0).sum(axis=1), 1)
    estimate = (hits / filled - 1 / 15) * (15 / 14)
    return estimate >= threshold - 5.4 * np.sqrt(threshold * (1 - threshold) / filled)


_LEAST_SALT = 0x2545F4914F6CDD1D


def linked(common: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (na + nb - common)


SKETCH = "doc_id long, text_key long, n_shingles long, fp1 long, fp2 long, regs binary, thin binary, low array<long>"


def _fingerprints(owner: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for salt in (0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35):
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(mix(value ^ np.uint64(salt)), out=total[1:])
        edge = np.searchsorted(owner, np.arange(rows + 1))
        out.append(mix(total[edge[1:]] - total[edge[:-1]]).view(np.int64))
    return out[0], out[1]


def _packed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    at = np.arange(len(rows) + 1) * rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def sketch(documents: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = byte_codes(lower=True)
        for batch in batches:
            for base, raw, at in chunks(batch.column(2)):
                rows = len(at) - 1
                owner, value = shingle_sets(raw, at, codes, shingle_words)
                fp1, fp2 = _fingerprints(owner, value, rows)
                regs = registers(owner, value, rows)
                n = np.bincount(owner, minlength=rows).astype(np.int64)
                keys, count = least_hashes(owner, value, n, percent)
                low = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(value[keys].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(base, rows), batch.column(1).slice(base, rows), pa.array(n), pa.array(fp1), pa.array(fp2), _packed(regs), _packed(thin(regs)), low], names=["doc_id", "text_key", "n_shingles", "fp1", "fp2", "regs", "thin", "low"])

    return documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, SKETCH)


def _matrix(column: pa.Array) -> np.ndarray:
    raw, _ = _bytes(column)
    return np.frombuffer(raw, np.uint16).reshape(-1, BUCKETS)


def _bytes(column: pa.Array) -> tuple[bytes, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return memoryview(column.buffers()[2] or b"")[at[0] : at[-1]], at - at[0]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, n, regs, low) to one row for each key that a class has: key, band, cid, n."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = band_keys(_matrix(batch.column(2)), batch.column(1).to_numpy())
        row, band = np.nonzero(keys)
        low = batch.column(3)
        owner = np.repeat(np.arange(len(low)), pa.compute.list_value_length(low).to_numpy())
        least = mix(low.flatten().to_numpy().view(np.uint64) + np.uint64(_LEAST_SALT))
        at = pa.array(np.concatenate([row, owner]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([keys[row, band], least]).view(np.int64)), pa.array(np.concatenate([band, np.full(len(owner), BANDS)]).astype(np.int8)), batch.column(0).take(at), batch.column(1).take(at)], names=["key", "band", "cid", "n"])


def _sets(shingle_words: int):
    """(cid, fp1, fp2, text) to cid, regs, shingles (sorted 64-bit hashes, packed) where the text is the class's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = byte_codes(lower=True)
        for batch in batches:
            for base, raw, at in chunks(batch.column(3)):
                rows = len(at) - 1
                owner, value = shingle_sets(raw, at, codes, shingle_words)
                fp1, fp2 = _fingerprints(owner, value, rows)
                part = batch.slice(base, rows)
                same = (part.column(1).to_numpy() == fp1) & (part.column(2).to_numpy() == fp2)
                edge = (np.searchsorted(owner, np.arange(rows + 1)) * 8).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(edge), pa.py_buffer(value)])
                keep = pa.array(same)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), _packed(registers(owner, value, rows)).filter(keep), packed.filter(keep)], names=["cid", "regs", "shingles"])

    return run


def _verify_pairs(percent: int):
    """(a, b, regs_a, regs_b, set_a, set_b) to the pairs that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = _matrix(batch.column(2)), _matrix(batch.column(3))
            (da, ea), (db, eb) = _bytes(batch.column(4)), _bytes(batch.column(5))
            na, nb = np.diff(ea) // 8, np.diff(eb) // 8
            keep = np.flatnonzero(plausible(ra, rb, na, nb, percent / 100))
            sets_a, sets_b = np.frombuffer(da, np.uint64), np.frombuffer(db, np.uint64)
            yes = [i for i in keep if linked(_common(sets_a[ea[i] // 8 : ea[i + 1] // 8], sets_b[eb[i] // 8 : eb[i + 1] // 8]), na[i], nb[i], percent)]
            at = pa.array(yes, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _find(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = x = parent[parent[x]]
    return x


def _groups(batches: Iterator[pa.RecordBatch], columns: int, rows: int) -> Iterator[pa.RecordBatch]:
    """The sorted stream in runs of about ``rows`` rows that never part rows with equal first columns."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(columns)])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        if held and [held[-1].column(i)[-1].as_py() for i in range(columns)] != key[:, 0].tolist():
            cuts = np.append(0, cuts)
        done = 0
        for cut in cuts:
            if size + cut - done >= rows:
                if cut > done:
                    held.append(batch.slice(done, cut - done))
                yield one_batch(held)
                held, size, done = [], 0, cut
        if done < batch.num_rows:
            held.append(batch.slice(done))
            size += batch.num_rows - done
    if held:
        yield one_batch(held)


def _flag_small(percent: int):
    """(key, band, late, cid, n, thin) sorted by key to (key, band, late, cid, n) of members that have a partner of
    like size in their bucket that their thin registers allow."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, 1, 4096):
            key, late, n = part.column(0).to_numpy(), part.column(2).to_numpy(zero_copy_only=False), part.column(4).to_numpy()
            bits = np.frombuffer(_bytes(part.column(5))[0], np.uint8).reshape(-1, BUCKETS // 2)
            marked = np.zeros(len(key), bool)
            for d in range(1, len(key)):
                a = np.flatnonzero(key[d:] == key[:-d])
                if not len(a):
                    break
                b = a + d
                near = (np.minimum(n[a], n[b]) * 100 >= percent * np.maximum(n[a], n[b])) & ~(late[a] & late[b])
                a, b = a[near], b[near]
                good = thin_plausible(bits[a], bits[b], percent / 100)
                marked[a[good]] = True
                marked[b[good]] = True
            yield part.filter(pa.array(marked)).select(range(5))

    return run


MEMBERS = "key long, i int, j int, block int, band byte, late boolean, cid long, component long"


def _plausible_pairs(part: pa.RecordBatch, regs: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows x and the later rows y of x's bucket that may be links between components: all of a bucket
    (i = j), or those of its blocks i and j.  A pair that shares several bands is met in one of
    them only, chosen by its ids, and in the lower of two size classes (not where both are late);
    one that shares several least hashes is met in each."""
    key, bi, bj, block, band, late, cid, component = (part.column(i).to_numpy(zero_copy_only=False) for i in range(8))
    keys = band_keys(regs, n)
    spin = (mix(cid.view(np.uint64)) >> np.uint64(8)).astype(np.int64)
    new = np.append(0, np.flatnonzero((key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1)
    for a, b in zip(new, np.append(new[1:], len(key)), strict=True):
        if b - a < 2 or component[a:b].min() == component[a:b].max():
            continue
        two = bi[a] != bj[a]
        for x in range(a, b - 1):
            y = np.arange(x + 1, b)
            y = y[(component[y] != component[x]) & ~(late[y] & late[x]) & (np.minimum(n[y], n[x]) * 100 >= percent * np.maximum(n[y], n[x]))]
            if two:
                y = y[block[y] != block[x]]
            if len(y):
                y = y[plausible(regs[x], regs[y], n[x], n[y], percent / 100)]
            if len(y) and band[x] < BANDS:
                common = (keys[y] == keys[x]) & (keys[x] != 0)
                turn = (np.arange(keys.shape[1])[None, :] - ((spin[x] + spin[y]) % keys.shape[1])[:, None]) % keys.shape[1]
                y = y[np.where(common, turn, 1 << 20).argmin(axis=1) == band[x]]
            if len(y):
                yield x, y


def _flag_members(percent: int):
    """MEMBERS, n, regs sorted by key, i, j to the MEMBERS that have a plausible partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, 3, 2048):
            marked = np.zeros(part.num_rows, bool)
            for x, y in _plausible_pairs(part, _matrix(part.column(9)), part.column(8).to_numpy(), percent):
                marked[x] = True
                marked[y] = True
            yield part.filter(pa.array(marked)).select(range(8))

    return run


def _link_members(percent: int):
    """MEMBERS, regs, shingles sorted by key, i, j to verified links (a, b) between components; no more
    than a spanning forest of those that a task sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, 3, 2048):
            data, edge = _bytes(part.column(9))
            sets, edge = np.frombuffer(data, np.uint64), edge // 8
            n, component = np.diff(edge), part.column(7).to_numpy()
            parent: dict[int, int] = {}
            links: list[tuple[int, int]] = []
            for x, y in _plausible_pairs(part, _matrix(part.column(8)), n, percent):
                root = _find(parent, int(component[x]))
                y = np.array([v for v in y if _find(parent, int(component[v])) != root], np.int64)
                if not len(y):
                    continue
                mine, size = sets[edge[x] : edge[x + 1]], n[y]
                first = np.append(0, np.cumsum(size)[:-1])
                other = sets[np.repeat(edge[y] - first, size) + np.arange(size.sum())]
                at = np.searchsorted(mine, other)
                at[at == len(mine)] = 0
                shared = np.add.reduceat((mine[at] == other).astype(np.int64), first)
                for v in y[linked(shared, n[x], size, percent)]:
                    one, two = _find(parent, int(component[x])), _find(parent, int(component[v]))
                    if one != two:
                        parent[two] = one
                        links.append((int(component[x]), int(component[v])))
            left, right = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _one_node(rows: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, a, b: for ids with several different sets, links from each of their classes to the least."""
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("fp1", "fp2", "n_shingles")).alias("lo"), F.max(F.struct("fp1", "fp2", "n_shingles")).alias("hi")).where("lo <> hi").select("doc_id")
    sets = rows.where("n_shingles > 0").select("doc_id", "fp1", "fp2", "n_shingles").join(several, "doc_id").distinct()
    nodes = scratch.table(sets.join(classes.select("fp1", "fp2", "n_shingles", "cid"), ["fp1", "fp2", "n_shingles"]).select("doc_id", "cid"), "repeated")
    return nodes.join(nodes.groupBy("doc_id").agg(F.min("cid").alias("b")), "doc_id").select("doc_id", F.col("cid").alias("a"), "b")


def near_duplicates(documents: DataFrame, scratch: Scratch, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_shingles, component_id (the smallest doc_id reachable), kept,
    of every row."""
    rows = scratch.table(sketch(documents, shingle_words, percent), "sketches")
    usable = rows.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.table(usable.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("cid"), F.first("regs").alias("regs"), F.first("thin").alias("thin"), F.first("low").alias("low")), "classes")
    keys = classes.select("cid", "n_shingles", "regs", "low").mapInArrow(_keys, "key long, band byte, cid long, n long")
    shared = keys.join(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key"), "key")
    # Only sets of like size can be linked: buckets are split by size, each set in its class and the next.
    like = F.floor(F.log("n") / float(np.log(100 / percent)) + 1e-9).cast("int")
    place = F.explode(F.array(F.struct(like.alias("like"), F.lit(False).alias("late")), F.struct((like + 1).alias("like"), F.lit(True).alias("late")))).alias("s")
    split = scratch.table(shared.select("key", "band", "cid", "n", place).select(F.xxhash64("key", "s.like").alias("key"), "band", "s.late", "cid", "n"), "shared")
    scratch.sweep()
    # A bucket of late members only repeats one of the class below.
    sizes = split.groupBy("key").agg(F.count("*").alias("size"), F.bool_and("late").alias("again")).where("size > 1 and not again").select("key", "size")
    rows_of = scratch.table(split.join(sizes, "key"), "buckets")
    # Members of small buckets without a plausible partner leave; large buckets are kept whole for now.
    small = rows_of.where(F.col("size") <= SMALL).join(classes.select("cid", "thin"), "cid").select("key", "band", "late", "cid", "n", "thin")
    kept = small.repartition("key").sortWithinPartitions("key").mapInArrow(_flag_small(percent), "key long, band byte, late boolean, cid long, n long")
    marked = scratch.table(kept.unionByName(rows_of.where(F.col("size") > SMALL).select("key", "band", "late", "cid", "n")), "marked")
    scratch.drop(split, rows_of)
    # Every class against the smallest member that it shares most buckets with.
    leaders = marked.groupBy("key").agg(F.min("cid").alias("leader"))
    votes = marked.join(leaders, "key").where("cid <> leader").groupBy("cid", "leader").count()
    stars = votes.groupBy("cid").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("leader"))
    involved = marked.select("cid").distinct().join(classes.select("cid", "fp1", "fp2"), "cid")
    texts = documents.select(F.col("doc_id").cast("long").alias("cid"), "text").join(involved, "cid").select("cid", "fp1", "fp2", "text")
    sets = scratch.table(texts.mapInArrow(_sets(shingle_words), "cid long, regs binary, shingles binary"), "sets")
    scratch.sweep()
    left = stars.join(sets, "cid").select(F.col("cid").alias("a"), F.col("leader").alias("b"), F.col("regs").alias("regs_a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("cid").alias("b"), F.col("regs").alias("regs_b"), F.col("shingles").alias("set_b"))
    tested = left.join(right, "b").select("a", "b", "regs_a", "regs_b", "set_a", "set_b")
    links = scratch.table(tested.mapInArrow(_verify_pairs(percent), "a long, b long"), "links")
    found = scratch.table(components(links, scratch), "components")
    # Buckets that hold several components: all pairs between those, in blocks inside tasks.
    placed = marked.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    open_ = placed.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key", F.ceil(F.greatest(F.col("size") / F.lit(BLOCK), F.col("shingles") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    dealt = placed.join(open_, "key").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "band", "late", "cid", "component")
    # First on registers alone; only members with a plausible partner are sent with their sets.
    sketched = dealt.join(classes.select("cid", "n_shingles", "regs"), "cid").select("key", "i", "j", "block", "band", "late", "cid", "component", "n_shingles", "regs")
    together = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    flagged = scratch.table(together(sketched).mapInArrow(_flag_members(percent), MEMBERS), "flagged")
    full = flagged.join(sets, "cid").select("key", "i", "j", "block", "band", "late", "cid", "component", "regs", "shingles")
    more = together(full).mapInArrow(_link_members(percent), "a long, b long")
    joined = scratch.table(more, "links").unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
    repeated = _one_node(rows, classes, scratch)
    joined = joined.unionByName(repeated.select("a", "b"))
    final = scratch.table(components(joined, scratch), "final")
    scratch.drop(marked, sets, links, found, flagged)
    scratch.sweep()
    named = classes.select("fp1", "fp2", "n_shingles", "cid").join(final.withColumnRenamed("node", "cid"), "cid", "left").select("fp1", "fp2", "n_shingles", F.coalesce("component", "cid").alias("class_component"))
    out = rows.drop("regs", "thin", "low").join(named, ["fp1", "fp2", "n_shingles"], "left")
    some = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    # Empty rows of an id that has texts too.
    of_id = repeated.groupBy("doc_id").agg(F.min("b").alias("node")).join(final, "node", "left").select("doc_id", F.coalesce("component", "node").alias("id_component"))
    empty = rows.where("n_shingles = 0 and doc_id is not null").select("doc_id").distinct().join(of_id, "doc_id")
    out = out.join(empty, "doc_id", "left")
    other = F.coalesce("id_component", "doc_id")
    component = F.when(some, F.col("class_component")).otherwise(other)
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
