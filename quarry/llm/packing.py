"""Vector best-fit packing of tokenised documents into sequences.

A document becomes its token ids and an end id; one longer than a sequence is cut
into full pieces and a shorter last one.  A piece demands a vector: its tokens, one
document, and its attention cost (length squared).  Sequences have a capacity in
each.  Pieces are placed longest first, each into the open sequence that holds it in every
capacity and is left with the smallest weighted residual norm (or has the smallest weighted dot
product of residual and demand); a new one opens when none does.  Lengths are whole
numbers up to ``max_tokens``, so this runs on the corpus' histogram of lengths (at most
``max_tokens`` counts, whatever the corpus' size), with sequences of equal residuals as one class.

The plan says, for each length, which ranks go to which sequence and offset.
Ranks within a length are counted in salted groups, so a length that a third of
all pieces share is spread over many tasks.

Defined results: null and empty texts are one end id; repeated rows are packed
each by itself; pieces of one length are ranked by their row, so ties don't depend on
how the rows are partitioned, nor do text order and ids; an empty table gives no pieces; very long texts are cut into full pieces; kept
columns travel in a struct, so names can't clash.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quarry.llm.common import attach, written

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


#: The tokenizer's own steps before its merges; with any other steps texts are encoded whole.
NORMALIZER = 'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\\s+"), content=" "), Lowercase()])'
SPLITTER = ('Sequence(pretokenizers=[Split(pattern=Regex("\'s|\'t|\'re|\'ve|\'m|\'ll|\'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"), '
            'behavior=Removed, invert=True), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])')
#: Byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ...
SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = np.arange(256, dtype="<u4")
BYTE_CHARS[[b for b in range(256) if b not in set(SELF)]] = 256 + np.arange(256 - len(SELF))
BYTE_CHARS[32] = 32  # parts the runs


def _classes() -> np.ndarray:
    """Class of each Latin-1 character as the tokenizer's split sees it: 0 blank, 1 letter, 2 number, 3 other sign."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(256)]
    return np.array([0 if c in BLANKS else 1 if k == "L" else 2 if k == "N" else 3 for c, k in enumerate(kinds)], np.uint8)


BLANKS = {*range(9, 14), 32, 0x85, 0xa0}
CLASS = _classes()
#: endings that stay with the apostrophe before them, by their first letter
ENDINGS = {b"s": b"s", b"t": b"t", b"m": b"m", b"d": b"d", b"r": b"re", b"v": b"ve", b"l": b"ll"}


def latin(text: str) -> bytes | None:
    """A Latin-1 text in lower case, a byte per character; None for other texts, whose normal form may differ, and for
    ones that may hold special tokens, whose case counts."""
    if "<|" in text:
        return None
    try:
        return text.lower().encode("latin-1")
    except UnicodeEncodeError:
        return None


def split_runs(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokenizer's split: the bytes that are no blanks, where its runs start among them, and which bytes stayed."""
    raw = np.frombuffer(joined, np.uint8)
    kind = CLASS[raw]
    cut = np.ones(len(raw), bool)
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    for i in np.flatnonzero(cut & (raw == 39)).tolist():  # an apostrophe that begins a run of signs
        tail = ENDINGS.get(joined[i + 1:i + 2])
        if tail and joined.startswith(tail, i + 1):
            cut[i + 1] = False
            if i + 1 + len(tail) < len(raw):
                cut[i + 1 + len(tail)] = True
    stays = kind != 0
    return raw[stays], np.flatnonzero(cut[stays]), stays


class Encoder:
    """Token ids of texts as bytes (little-endian unsigned 32-bit).

    The tokenizer drops white space and joins nothing across its runs of letters, digits and other
    signs, so a text's ids are its runs' ids.  A lot of texts is split at once, its runs are made a dictionary, and
    only the dictionary's entries are looked up one by one.  Those not met before go through the tokenizer's merges
    many at a time; each ends in a token marked as a word's last, which tells them apart again.  Texts beyond Latin-1 are
    taken word by word, the words through the whole tokenizer.  Runs and words met before come from two tables: when the
    young one has ``most`` entries it becomes the old one, and what is still met in the old one moves on to the young one.
    """

    def __init__(self, path: str, most: int = 150_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.by_run = (str(self.tokenizer.normalizer), str(self.tokenizer.pre_tokenizer)) == (NORMALIZER, SPLITTER)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.most = most
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def put(self, run: bytes, ids: bytes) -> bytes:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[run] = ids
        return ids

    def get(self, run: bytes) -> bytes | None:
        if (ids := self.young.get(run)) is None and (ids := self.old.get(run)) is not None:
            self.put(run, ids)
        return ids

    def merged(self, runs: list[bytes], at_once: int = 500) -> list[bytes]:
        """Ids of runs not met before."""
        out = []
        lots = [runs[i:i + at_once] for i in range(0, len(runs), at_once)]
        texts = [BYTE_CHARS[np.frombuffer(b" ".join(lot).decode("latin-1").encode(), np.uint8)].tobytes().decode("utf-32-le") for lot in lots]
        for lot, e in zip(lots, self.merges.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(lot) or ends[-1] != len(ids):
                raise ValueError("the vocabulary does not mark the last token of a word")
            raw, at = ids.tobytes(), 0
            for end in (4 * ends).tolist():
                out.append(raw[at:end])
                at = end
        return out

    def looked_up(self, runs: list[bytes], times: np.ndarray) -> list[bytes]:
        """Ids of distinct runs; those that occur but once among the texts at hand are not kept."""
        found = list(map(self.young.get, runs))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            found[i] = self.get(runs[i])
        new = [i for i, ids in enumerate(found) if ids is None]
        for i, ids, n in zip(new, self.merged([runs[i] for i in new]), times[new].tolist()):
            found[i] = ids if n == 1 else self.put(runs[i], ids)
        return found

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def by_word(self, text: str) -> bytes:
        out = []
        for w in text.encode().split():  # at ASCII blanks only; the blank keeps words apart from runs of the same bytes
            if (ids := self.get(b" " + w)) is None:
                ids = self.put(b" " + w, self.whole(w.decode()))
            out.append(ids)
        return b"".join(out)

    def lot(self, texts: list[bytes]) -> list[bytes]:
        """Ids of lower-cased Latin-1 texts."""
        joined = b"\n".join(texts) + b"\n"
        chars, starts, stays = split_runs(joined)
        if not len(starts):
            return [b""] * len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        kept = np.add.reduceat(stays, np.cumsum(sizes) - sizes, dtype=np.int64)
        bounds = np.append(starts, len(chars)).astype(np.int32)
        runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(chars)]).dictionary_encode()
        at = runs.indices.to_numpy()
        found = self.looked_up(runs.dictionary.to_pylist(), np.bincount(at))
        ids = np.frombuffer(b"".join(found), "<u4")
        n_ids = np.fromiter(map(len, found), np.int64, len(found)) // 4
        many = n_ids[at]
        ends = np.cumsum(many)
        out = ids[np.repeat((np.cumsum(n_ids) - n_ids)[at] - ends + many, many) + np.arange(ends[-1])].tobytes()
        cuts = [0, *(4 * np.append(0, ends)[np.searchsorted(starts, np.cumsum(kept))]).tolist()]
        return [out[a:b] for a, b in zip(cuts, cuts[1:])]

    def ids(self, text: str | None) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str | None], lot: int = 1 << 22) -> list[bytes]:
        """Ids of texts, which are taken about ``lot`` characters at a time."""
        if not self.by_run:
            return [self.whole(t) if t else b"" for t in texts]
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            size, plain, place = 0, [], []
            while at < len(texts) and size < lot:
                text = texts[at] or ""
                size += len(text)
                held = latin(text)
                if held is None:
                    out.append(self.by_word(text))
                else:
                    place.append(len(out))
                    plain.append(held)
                    out.append(b"")
                at += 1
            for i, ids in zip(place, self.lot(plain) if plain else []):
                out[i] = ids
        return out


@cache
def encoder(path: str) -> Encoder:
    """One per Python worker, kept over its tasks."""
    return Encoder(path)


def pieces(docs: DataFrame, keep: list[str], path: str, max_tokens: int = 4096, end_id: int = 1,
           with_ids: bool = False) -> DataFrame:
    """``row``, piece, start, length, ids_crc32 (and the ids, if asked for) of every piece."""
    def start():
        ids_of, end = encoder(path).many, struct.pack("<I", end_id)

        def fn(texts):
            out = []
            for ids in ids_of(texts):
                ids += end
                row = []
                for i, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                    part = ids[at:at + 4 * max_tokens]
                    row.append({"piece": i, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
                               | ({"ids": np.frombuffer(part, "<u4").tolist()} if with_ids else {}))
                out.append(row)
            return {"pieces": out}
        return fn

    fields = "piece:int,start:long,length:long,ids_crc32:long" + ",ids:array<int>" * with_ids
    return (attach(docs, keep, ["text"], f"pieces array<struct<{fields}>>", start)
            .select("row", F.explode("pieces").alias("p")).select("row", "p.*"))


class _Bins:
    """Open bins in classes: ``count`` sequences from ``first`` on with the same residual vector."""

    def __init__(self):
        self.rest, self.count, self.first, self.n = np.zeros((1024, 3), np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0

    def add(self, rest: np.ndarray, count: int, first: int) -> None:
        if count <= 0 or (rest <= 0).any():
            return
        if self.n == len(self.count):
            live = np.flatnonzero(self.count)  # closed classes make room, else there is more of it
            grow = 2 * len(live) + 1024
            self.n = len(live)
            for name in ("rest", "count", "first"):
                old = getattr(self, name)
                new = np.zeros((grow, *old.shape[1:]), np.int64)
                new[:self.n] = old[live]
                setattr(self, name, new)
        self.rest[self.n], self.count[self.n], self.first[self.n] = rest, count, first
        self.n += 1

    def best(self, demand: np.ndarray, caps: np.ndarray, weights: np.ndarray, score: str) -> tuple[np.ndarray, int, int] | None:
        """Takes out the class that fits the demand in every capacity and fits it best."""
        fits = np.flatnonzero((self.count[:self.n] > 0) & (self.rest[:self.n] >= demand).all(axis=1))
        if not len(fits):
            return None
        rest, need = self.rest[fits] / caps, demand / caps
        value = (rest * need * weights).sum(axis=1) if score == "dot" else ((rest - need) ** 2 * weights).sum(axis=1)
        j = fits[np.argmin(value)]
        found = self.rest[j].copy(), int(self.count[j]), int(self.first[j])
        self.count[j] = 0
        return found


def plan(counts: dict[int, int], max_tokens: int = 4096, max_docs: int = 4096, max_attention: int = 4096 ** 2,
         weights: tuple[float, float, float] = (1.0, 0.1, 0.1), score: str = "norm") -> np.ndarray:
    """Rows (length, first rank, uses per sequence, first sequence, offset), sorted by length and rank."""
    room = np.array([max_tokens, max_docs, max_attention], np.int64)
    caps, w, bins = room.astype(float), np.array(weights), _Bins()
    rows, sequences = [], 0
    for length in sorted(counts, reverse=True):
        demand = np.array([length, 1, length * length], np.int64)
        if (demand > room).any():
            raise ValueError("a piece fits no sequence")
        left, used = counts[length], 0
        while left:
            found = bins.best(demand, caps, w, score)
            if found is None:  # no open bin fits: as many new ones as the rest of this length needs
                found = room, -(-left // int((room // demand).min())), sequences
                sequences += found[1]
            rest, n, first = found
            uses = int((rest // demand).min())  # a bin stays the best for its like until no more fit
            full = min(n, left // uses)
            at = int(max_tokens - rest[0])
            if full:
                rows.append((length, used, uses, first, at))
                used, left = used + uses * full, left - uses * full
                bins.add(rest - uses * demand, full, first)
            if full < n and 0 < left:  # the last few of this length share one more bin
                rows.append((length, used, left, first + full, at))
                bins.add(rest - left * demand, 1, first + full)
                used, left, full = used + left, 0, full + 1
            bins.add(rest, n - full, first + full)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(items: DataFrame, group: str, tie: list[str], per_group: int = 4096) -> DataFrame:
    """``items`` with ``rank``: 0, 1, ... within each value of ``group``, counted in salted groups of
    about ``per_group`` rows at most, so that a frequent value is dealt to many tasks."""
    salts = max(1, -(-items.count() // per_group))
    salted = items.withColumn("salt", F.pmod(F.xxhash64(*tie), F.lit(salts)))
    base = (salted.groupBy(group, "salt").agg(F.count("*").alias("n"))
            .withColumn("base", F.sum("n").over(Window.partitionBy(group).orderBy("salt")) - F.col("n")).drop("n"))
    own = F.row_number().over(Window.partitionBy(group, "salt").orderBy(*tie)) - 1
    return (salted.withColumn("own", own).join(base, [group, "salt"])
            .withColumn("rank", F.col("base") + F.col("own")).drop("salt", "own", "base"))


def pack(docs: DataFrame, keep: list[str] | None = None, path: str | None = None, max_tokens: int = 4096,
         max_docs: int = 4096, max_attention: int = 4096 ** 2, score: str = "norm", with_ids: bool = False) -> DataFrame:
    """``row``, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    cut = written(pieces(docs, docs.columns if keep is None else keep, path or tokenizer_path(), max_tokens,
                         with_ids=with_ids), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().toLocalIterator()}
    layout = spark.sparkContext.broadcast(plan(counts, max_tokens, max_docs, max_attention, score=score))
    items = ranked(cut, "length", ["row", "piece", "ids_crc32"])
    schema = "sequence_id long, offset long"

    def start():
        table = layout.value
        key = table[:, 0] << 40 | table[:, 1]

        def fn(lengths, ranks):
            n, r = np.array(lengths, np.int64), np.array(ranks, np.int64)
            row = table[np.searchsorted(key, n << 40 | r, side="right") - 1] if len(n) else np.zeros((0, 5), np.int64)
            nth = r - row[:, 1]
            return {"sequence_id": pa.array(row[:, 3] + nth // np.maximum(row[:, 2], 1)),
                    "offset": pa.array(row[:, 4] + nth % np.maximum(row[:, 2], 1) * n)}
        return fn

    return (attach(items, [c for c in items.columns if c != "rank"], ["length", "rank"], schema, start)
            .select("row.*", "sequence_id", "offset"))


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's digest per piece.  The document-count and attention caps of a sequence are
    those that 4096 tokens imply, so they never add sequences here."""
    return pack(docs, ["doc_id"], path).select(F.col("row.doc_id").alias("doc_id"), "piece", "start", "length", "ids_crc32",
                                               "sequence_id", "offset")
