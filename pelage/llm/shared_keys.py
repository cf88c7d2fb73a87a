"""Which 64-bit keys occur more than once in the whole input, or with a smaller owner?

Owners (documents) carry lists of keys. A task takes its owners in chunks of
a few hundred thousand keys. A key that repeats inside the chunk is settled there: its
owners are told at once, and one announcement leaves the chunk. All other keys
travel with their owners, packed, to the range of the key space they belong
to, where a sort finds the repeats. A key that a third of all owners hold
therefore sends one entry per chunk, and ranges of hashed keys are even. The
answers go back packed, to the bucket of their owner.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pelage.llm.hashing import U64, mix, pack, unpack
from pelage.llm.storage import released

CHUNK_KEYS = 1 << 18
_PACKED = "part int, owners binary, counts binary, keys binary, known binary"
_SCHEMA = pa.schema([("part", pa.int32()), ("owners", pa.binary()), ("counts", pa.binary()),
                     ("keys", pa.binary()), ("known", pa.binary())])
_PACKED_HITS = "bucket int, owners binary, counts binary, keys binary"
_HITS = pa.schema([("bucket", pa.int32()), ("owners", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])


def _runs(owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of the runs of equal neighbours."""
    if not len(owners):
        return owners, np.zeros(0, np.int64)
    cut = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
    return owners[cut], np.diff(np.r_[cut, len(owners)])


def _split(key: np.ndarray, owner: np.ndarray, later: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries sorted by key (then owner): (hits, entries still to be asked about, keys known to repeat)."""
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    if later:
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
        return owner > owner[head], ~same, key[:0]
    repeated = same.copy()
    repeated[:-1] |= same[1:]
    return repeated, ~repeated, key[repeated & ~same]


@released
def _chunks(batches: Iterator[pa.RecordBatch], parts: int, later: bool) -> Iterator[pa.RecordBatch]:
    def settle(owners: list[int], keys: list[np.ndarray]) -> pa.RecordBatch:
        owner = np.repeat(np.array(owners, np.int64), [len(k) for k in keys])
        key = np.concatenate(keys)
        order = np.lexsort((owner, key)) if later else np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        hit, ask, known = _split(key, owner, later)
        rows = []
        inside, told = key[hit], owner[hit]
        if len(inside):
            by = np.argsort(told, kind="stable")
            who, n = _runs(told[by])
            # Spread by chunk content: these rows only pass through.
            rows.append((int(inside[0] % U64(parts)), pack(who, "<i8"), pack(n, "<i4"), b"", pack(inside[by], "<u8")))
        key, owner = key[ask], owner[ask]
        edge = (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(U64)
        cuts, known_cuts = np.searchsorted(key, edge), np.searchsorted(known, edge)
        for part, (ask, say) in enumerate(zip(np.split(np.arange(len(key)), cuts), np.split(known, known_cuts))):
            if len(ask) or len(say):
                by = ask[np.argsort(owner[ask], kind="stable")]
                who, n = _runs(owner[by])
                rows.append((part, pack(who, "<i8"), pack(n, "<i4"), pack(key[by], "<u8"), pack(say, "<u8")))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)

    owners: list[int] = []
    keys: list[np.ndarray] = []
    held = 0
    for batch in batches:
        for owner, value in zip(batch.column("owner").to_pylist(), batch.column("keys")):
            found = unpack(value.as_buffer(), "<u8") if value.is_valid else ()
            if owner is None or not len(found):
                continue
            owners.append(owner)
            keys.append(found)
            held += len(found)
            if held >= CHUNK_KEYS:
                yield settle(owners, keys)
                owners, keys, held = [], [], 0
    if held:
        yield settle(owners, keys)


def _by_owner(owner: np.ndarray, key: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Hits packed by owner bucket."""
    at = (mix(owner.view(U64)) % U64(buckets)).astype(np.int32)
    order = np.lexsort((owner, at))
    at, owner, key = at[order], owner[order], key[order]
    cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    rows = []
    for low, high in zip(cut, np.r_[cut[1:], len(at)]):
        who, n = _runs(owner[low:high])
        rows.append((int(at[low]), pack(who, "<i8"), pack(n, "<i4"), pack(key[low:high], "<u8")))
    return pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 4, _HITS.types)], schema=_HITS)


@released
def _settle_part(batches: Iterator[pa.RecordBatch], later: bool, buckets: int) -> Iterator[pa.RecordBatch]:
    keys, owners, known = [], [], []
    for batch in batches:
        for row in zip(*[batch.column(k) for k in ("owners", "counts", "keys", "known")]):
            who, n = unpack(row[0].as_buffer(), "<i8"), unpack(row[1].as_buffer(), "<i4")
            asked, said = unpack(row[2].as_buffer(), "<u8"), unpack(row[3].as_buffer(), "<u8")
            if len(who) and not len(asked):  # settled in its chunk
                yield _by_owner(np.repeat(who, n), said, buckets)
                continue
            keys.append(asked.copy())
            owners.append(np.repeat(who, n))
            known.append(said.copy())
    if keys:
        key, owner, said = np.concatenate(keys), np.concatenate(owners), np.concatenate(known)
        keys, owners, known = [], [], []
        sure = np.unique(said)
        order = np.lexsort((owner, key)) if later else np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        hit, _, _ = _split(key, owner, later)
        if len(sure):
            at = np.minimum(np.searchsorted(sure, key), len(sure) - 1)
            hit |= sure[at] == key
        yield _by_owner(owner[hit], key[hit], buckets)


@released
def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per owner with its distinct keys in order."""
    owners, keys = [], []
    for batch in batches:
        for row in zip(*[batch.column(k) for k in ("owners", "counts", "keys")]):
            owners.append(np.repeat(unpack(row[0].as_buffer(), "<i8"), unpack(row[1].as_buffer(), "<i4")))
            keys.append(unpack(row[2].as_buffer(), "<u8").copy())
    if not owners:
        return
    owner, key = np.concatenate(owners), np.concatenate(keys)
    owners, keys = [], []
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    owner, key = owner[fresh], key[fresh]
    who, n = _runs(owner)
    ends = np.cumsum(n)
    for low in range(0, len(who), 4096):
        part = slice(low, low + 4096)
        yield pa.RecordBatch.from_pydict({
            "owner": pa.array(who[part], pa.int64()),
            "keys": pa.array([pack(key[e - m:e], "<u8") for e, m in zip(ends[part], n[part])], pa.binary())})


Extract = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def shared_keys(source: DataFrame, extract: Extract, later: bool = False) -> DataFrame:
    """``owner, keys``: one row per owner with those of its keys that occur at least twice, sorted and packed.

    ``extract`` turns batches of ``source`` into batches of ``owner long, keys
    binary`` (packed 64-bit unsigned integers) inside the task that reads them;
    a key that one owner lists twice counts twice. With ``later`` only the keys
    that some smaller owner holds as well. Owners without such keys have no row.
    """
    width = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = 4 * width
    packed = source.mapInArrow(lambda b: _chunks(extract(b), parts, later), _PACKED)
    hits = packed.repartition(2 * width, "part").mapInArrow(lambda b: _settle_part(b, later, width), _PACKED_HITS)
    return hits.repartition(width, "bucket").mapInArrow(_collect, "owner long, keys binary")
