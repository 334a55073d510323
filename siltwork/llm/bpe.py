"""BPE encoding and decoding over a pair occurrence index.

The distinct words of a partition, as they are first met in its chunks, stand in one array of symbols a chunk. An index
maps each merge rank to all the positions of its pair. The smallest active rank is applied at all its positions at once, left to right where they
overlap; the pairs that this makes and unmakes move between the lists of their ranks, and the next smallest active
rank follows. A merge may activate a smaller rank than its own, so ranks wait in a heap. This gives each word the
merges that it would get alone: the smallest rank first, the leftmost of equals.

The vocabulary is a file of the tokenizers library for BPE with an end-of-word suffix; its normaliser (NFC, white space,
lower case), its splitting pattern and its added tokens are read from it. Encoded ids are little-endian unsigned 32-bit
integers in a binary column.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

#: Characters of text in memory at once; a longer text is a chunk of its own.
CHUNK_CHARS = 3_000_000
OUT_CHARS = 1_000_000
#: Words whose ids are kept from chunk to chunk of a partition; beyond it all are forgotten.
KNOWN_WORDS = 120_000
_NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def _young(pattern: str) -> tuple[dict[int, str], dict[int, str]]:
    """What this Python's tables and the library's, which grow with Unicode, don't agree on: code points that they class
    differently, with a character of the class that the library gives; and those with another lower case there."""
    import regex
    from tokenizers import Regex
    from tokenizers.normalizers import Lowercase
    from tokenizers.pre_tokenizers import Split

    split = Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
    ours = regex.compile(pattern).findall
    small = Lowercase().normalize_str
    out, lower = {}, {}
    for plane in range(0, 0x110000, 0x1000):
        young = "".join(c for c in map(chr, range(plane, plane + 0x1000)) if unicodedata.category(c) == "Cn")
        lower |= {ord(c): small(c) for c in young if small(c) != c.lower()}
        for c in regex.findall(r"[\p{L}\p{N}]", young):
            joined, twice = (["".join(x[0]) for x in split(t)] for t in ("a" + c, c + c))
            if (joined, twice) != (ours("a" + c), ours(c + c)):
                out[ord(c)] = "a" if len(joined) == 1 else "0" if len(twice) == 2 else "#"
    return out, lower


class PairIndexBPE:
    def __init__(self, spec: dict):
        import regex

        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("a BPE model without dropout, byte fallback and subword prefix is needed")
        if [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in spec["pre_tokenizer"]["pretokenizers"]] != ["Split", "ByteLevel"] or spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("this file's steps are not known here")
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.pieces = [""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for piece, i in [*vocab.items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
            self.pieces[i] = piece
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        self.stand_ins, self.lower = _young(pattern)
        self.young = frozenset(map(chr, {*self.stand_ins, *self.lower, *(ord(x) for x in self.lower.values())}))
        self.youngest = min(map(ord, self.young), default=0x110000)
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made
        self.same = np.array([a == b for a, b in pairs])

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def pretokens(self, text: str) -> list[str]:
        """Words of a text, and its added tokens as they are, after a NUL that no word can start with."""
        if self.split_added is None or not any(x in text for x in self.added):
            return self.words(text)
        out: list[str] = []
        for i, part in enumerate(self.split_added.split(text)):
            out += ["\0" + part] if i % 2 else self.words(part)
        return out

    def words(self, text: str) -> list[str]:
        """Normalise and split. Lower case goes without the one rule that looks at neighbours; white space of any kind
        only separates."""
        text = unicodedata.normalize("NFC", text)
        if text.isascii() or int(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").max()) < self.youngest or self.young.isdisjoint(text):
            return self.pattern.findall(text.replace("Σ", "σ").lower())
        text = text.translate(self.lower).replace("Σ", "σ").lower()
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.stand_ins))]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and where each word's begin (one more than words)."""
        if not words:
            return np.empty(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        sym = self.inner[data]
        sym[ends - 1] = self.last[data[ends - 1]]
        n = len(sym)
        nxt = np.arange(1, n + 1)
        nxt[ends - 1] = -1
        prv = np.arange(-1, n - 1)
        prv[ends - lengths] = -1
        rank = np.full(n, _NONE)
        inside = np.flatnonzero(nxt >= 0)
        rank[inside] = self.rank_of(sym[inside], sym[nxt[inside]])
        alive = np.ones(n, dtype=bool)

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            at = at[rank[at] != _NONE]
            if not len(at):
                return
            own = rank[at]
            order = np.argsort(own, kind="stable")
            at, own = at[order], own[order]
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            for part, r in zip(np.split(at, cuts) if len(cuts) else [at], own[np.append(0, cuts)].tolist(), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        enter(inside)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if self.same[r]:
                at = np.sort(at)
                keep, gone = [], -1
                for p in at.tolist():
                    if p != gone:
                        keep.append(p)
                        gone = int(nxt[p])
                at = np.array(keep)
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = self.made[r]
            alive[gone] = False
            rank[gone] = _NONE
            nxt[at] = after
            prv[after[after >= 0]] = at[after >= 0]
            before = prv[at]
            touched = np.concatenate([at, before[before >= 0]])
            if len(at) > 1:
                touched = np.unique(touched)
            follows = nxt[touched]
            rank[touched[follows < 0]] = _NONE
            touched, follows = touched[follows >= 0], follows[follows >= 0]
            if len(touched):
                rank[touched] = self.rank_of(sym[touched], sym[follows])
                enter(touched)
        counts = np.add.reduceat(alive.astype(np.int64), ends - lengths)
        return sym[alive].astype(np.uint32), np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(counts)])

    def encode(self, texts: Iterable[str | None], known: Known | None = None) -> Iterator[np.ndarray]:
        """Ids of each text, from one index over the distinct words of all that known hasn't met."""
        known = known or Known()
        if len(known.number) > KNOWN_WORDS:
            known.forget()
        number, met = known.number, len(known.number)
        places = [np.fromiter(map(number.__getitem__, self.pretokens(t or "")), dtype=np.int32) for t in texts]
        words = list(islice(number, met, None))
        special = np.array([self.added[w[1:]] if w[0] == "\0" and w[1:] in self.added else -1 for w in words], dtype=np.int64)
        plain = [w for w, s in zip(words, special.tolist(), strict=True) if s < 0]
        flat, edges = self.encode_words(plain)
        begins, sizes = np.empty(len(words), dtype=np.int64), np.empty(len(words), dtype=np.int64)
        begins[special < 0], sizes[special < 0] = edges[:-1], np.diff(edges)
        begins[special >= 0], sizes[special >= 0] = len(flat) + np.arange((special >= 0).sum()), 1
        known.add(np.concatenate([flat, special[special >= 0].astype(np.uint32)]), begins, sizes)
        for at in places:
            size = known.sizes[at]
            upto = np.cumsum(size)
            yield known.flat[np.arange(upto[-1] if len(upto) else 0) + np.repeat(known.begins[at] - upto + size, size)]

    def decode(self, ids: np.ndarray) -> str:
        """The pieces of ids with a blank between, as the library gives for a file without a decoder."""
        return " ".join(map(self.pieces.__getitem__, ids.tolist()))


class Known:
    """Words with numbers, and the ids of each: flat[begins:begins + sizes]."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.flat, self.begins, self.sizes = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def add(self, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> None:
        self.begins, self.sizes = np.append(self.begins, begins + len(self.flat)), np.append(self.sizes, sizes)
        self.flat = np.append(self.flat, flat)


@lru_cache(maxsize=1)
def from_text(spec: str) -> PairIndexBPE:
    return PairIndexBPE(json.loads(spec))


def encode_decode(docs: DataFrame, vocabulary: str, *, text: str = "text", keep: list[str]) -> DataFrame:
    """The columns keep of docs with token_ids (binary, 4 bytes an id), n_tokens and decoded (the text of the ids).

    vocabulary: path of the tokenizer file, as the driver sees it. Null and empty texts have no ids. Words that hold
    text of added tokens are those tokens. Repeated rows each get their own result.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = from_text(shared.value), Known()
        for batch in batches:
            start = 0
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch["t"]), 0).to_numpy(zero_copy_only=False)
            upto = np.cumsum(sizes)
            while start < batch.num_rows:
                # Rows until the chunk is full, one at least.
                stop = max(start + 1, int(np.searchsorted(upto, CHUNK_CHARS + (upto[start - 1] if start else 0), side="right")))
                yield from done(bpe, known, batch.slice(start, stop - start))
                start = stop
        del known
        give_back()

    def done(bpe: PairIndexBPE, known: Known, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = (x.as_py() for x in rows["t"])
        start, held, out = 0, [], 0

        def batch() -> pa.RecordBatch:
            cols = {n: rows[n].slice(start, len(held)) for n in names}
            cols["token_ids"] = pa.array([x.astype("<u4").tobytes() for x in held], pa.binary())
            cols["n_tokens"] = pa.array([len(x) for x in held], pa.int64())
            cols["decoded"] = pa.array([bpe.decode(x) for x in held], pa.string())
            return pa.RecordBatch.from_pydict(cols)

        for ids in bpe.encode(texts, known):
            held.append(ids)
            out += 8 * len(ids)
            if out >= OUT_CHARS:
                yield batch()
                start, held, out = start + len(held), [], 0
        if held:
            yield batch()

    kinds = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in names)
    out = rows.mapInArrow(work, kinds + "token_ids binary, n_tokens long, decoded string")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "token_ids", "n_tokens", "decoded")
