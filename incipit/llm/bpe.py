"""Byte-level BPE encoding and decoding.

Encoding splits the text at added tokens and then by the byte-level pattern; each piece's bytes form a doubly linked list of
symbols, and a priority queue of (merge rank, position) applies merges, skipping entries whose symbols have changed.
Decoding concatenates the vocabulary's byte strings. Rows never meet: one narrow pass, Arrow batches in, digests out.

The vocabulary file's path is a parameter; the driver reads it and broadcasts its few MB, so executors need no copy. Each
Python worker keeps the pieces it has encoded in a table of bounded size, which saves time and changes no result.

Edge cases: null text encodes as the empty text (no ids); texts are never cut; repeated rows each get their row; an empty
table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

#: Pieces kept by a worker before its table starts anew.
KEPT_PIECES = 300_000
#: How byte-level files split text. White space is spelled out: `\s` also takes U+001C to U+001F in some engines.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and back."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def unmet(j: dict) -> list[str]:
    """Settings of a file of the tokenizers library that would change its ids and that ByteBPE does not follow."""
    before, model = j.get("pre_tokenizer") or {}, j["model"]
    odd = ["normalizer"] * bool(j.get("normalizer")) + ["post_processor"] * bool((j.get("post_processor") or {"type": "ByteLevel"})["type"] != "ByteLevel")
    odd += ["pre_tokenizer"] * (before.get("type") != "ByteLevel" or not before.get("use_regex", True)) + ["add_prefix_space"] * bool(before.get("add_prefix_space"))
    odd += [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)] + ["model type"] * (model.get("type") != "BPE")
    return odd + sorted({k for t in j["added_tokens"] for k in ("single_word", "lstrip", "rstrip") if t.get(k)})


class ByteBPE:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, spec: str):
        import regex

        j = json.loads(spec)
        if odd := unmet(j):
            raise ValueError(f"the file sets what this encoder does not do: {', '.join(odd)}")
        letters = byte_letters()
        vocab = j["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.first = [0] * 256
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.added = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.split_added = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pieces = regex.compile(PATTERN).findall
        self.names = {i: str(i) for i in self.bytes_of}
        self.kept: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        ids = [self.first[b] for b in data]
        n, merges = len(ids), self.merges
        if n < 2:
            return tuple(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(m[0], k, m[1], ids[k], ids[k + 1]) for k in range(n - 1) if (m := merges.get((ids[k], ids[k + 1])))]
        heapify(queue)
        while queue:
            _, k, new, left, right = heappop(queue)
            nxt = after[k]
            if ids[k] != left or nxt < 0 or ids[nxt] != right:
                continue  # stale: one of the two symbols was merged since
            ids[k], ids[nxt] = new, -1
            follow = after[k] = after[nxt]
            if follow >= 0:
                before[follow] = k
                if m := merges.get((new, ids[follow])):
                    heappush(queue, (m[0], k, m[1], new, ids[follow]))
            if (prev := before[k]) >= 0 and (m := merges.get((ids[prev], new))):
                heappush(queue, (m[0], prev, m[1], ids[prev], new))
        return tuple(i for i in ids if i >= 0)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.split_added.split(text) if self.split_added and any(s in text for s in self.added) else (text,):
            if part in self.added:
                ids.append(self.added[part])
                continue
            for piece in self.pieces(part):
                got = self.kept.get(piece)
                if got is None:
                    got = self.merged(piece.encode())
                    if len(piece) <= 64:
                        if len(self.kept) >= KEPT_PIECES:
                            self.kept.clear()
                        self.kept[piece] = got
                ids += got
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, ByteBPE] = {}


def loaded(spec: str) -> ByteBPE:
    """One encoder a worker and vocabulary."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBPE(spec)
    return _loaded[key]


def encode_documents(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves on request."""
    spec = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    kinds = [None, pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for batch in batches:
            n, digest, back, every = [], [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids))
                digest.append(hashlib.sha256(",".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                if with_ids:
                    every.append(ids)
            made = [batch.column(0)] + [pa.array(v, k) for v, k in zip([n, digest, back] + [every] * with_ids, kinds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(made, names)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
