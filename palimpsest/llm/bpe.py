"""Byte-level BPE: text to ids and offsets by the tokenizers library over Arrow batches, and ids back to bytes.

The rank file of a vocabulary (base64 token, rank) becomes a tokenizers model: each byte is written as a printable
character, and the merges are those that build each token from lower ranks. The driver builds that model once and sends
it with the tasks; its size is the vocabulary's, whatever the input.
"""

import base64
import codecs
import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common
from .common import release, slices

RANKS = "byte_bpe_50k.tiktoken"
#: A word and the white space before it, without the ASCII punctuation that follows letters. The pattern ends every match
#: where white space follows anything else and where such punctuation follows a letter, so words encoded one by one give
#: the ids of the text. U+001C to U+001F are no white space to the pattern.
_WORD = re.compile(r"[^\S\x1c-\x1f]*(?:[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[!-/:-@\[-`{-~])|[\S\x1c-\x1f]+)|[^\S\x1c-\x1f]+")
#: Longer texts are encoded piece by piece, so that memory doesn't follow the longest text; a piece ends with a word.
PIECE_CHARS = 1 << 20
_CUT = re.compile(r"[\S\x1c-\x1f](?=[^\S\x1c-\x1f])")
#: Words whose ids a worker remembers, and the longest of them.
CACHE_WORDS = 150_000
CACHE_CHARS = 48
#: So many new words are encoded as one text.
JOINED_WORDS = 5_000
_INNER = re.compile(r" [\S\x1c-\x1f]+")


@lru_cache(1)
def byte_chars() -> tuple[str, ...]:
    """The character for each byte: itself where printable, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return tuple(chr(0x100 + hidden.index(b)) if b in hidden else chr(b) for b in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that merges of lower rank leave of a token."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= ranks[token]:
            raise ValueError(f"no merges lead to {token!r}")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


@lru_cache(4)
def model_json(path: str, pattern: str = public_tokenizers.PATTERN) -> str:
    """The tokenizers model of a rank file, as JSON."""
    ranks, chars = read_ranks(path), byte_chars()
    shown = lambda token: "".join(chars[b] for b in token)
    merges = [[shown(x) for x in _halves(token, ranks)] for token in sorted(ranks, key=ranks.get) if len(token) > 1]
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        ]},
        "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {shown(t): r for t, r in ranks.items()}, "merges": merges},
    })


def cut(text: str, piece_chars: int = PIECE_CHARS) -> list[str]:
    """text in pieces of about piece_chars; a longer stretch without white space stays whole."""
    pieces, start = [], 0
    while len(text) - start > piece_chars and (end := _CUT.search(text, start + piece_chars - 1)):
        pieces.append(text[start : end.end()])
        start = end.end()
    return [*pieces, text[start:]]


class ByteBpe:
    """Encodes and decodes with one model; made once in each task."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        codes = {c: b for b, c in enumerate(byte_chars())}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.tokens = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.tokens[i] = bytes(codes[c] for c in token)
        self.lengths = np.array([len(t) for t in self.tokens])
        self.ids: dict[str, bytes] = {}  # a word's ids, and its spans, as int32
        self.spans: dict[str, bytes] = {}

    def _joined(self, words: list[str]) -> None:
        """Ids of words that start with a space and hold no other white space, encoded as one text and parted by their bytes."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, "<i4")
        cuts = (np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(w.encode()) for w in words])) + 1) * 4
        flat = ids.tobytes()
        self.ids.update(zip(words, [flat[a:e] for a, e in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)], strict=True))

    def _learn(self, words: list[list[str]], offsets: bool) -> list[str]:
        """Encode the words that aren't known yet; gives those that aren't to be remembered."""
        known = self.spans if offsets else self.ids
        full = len(self.ids) >= CACHE_WORDS  # the words that came first stay: frequent ones are among them
        new = list(set(chain.from_iterable(words)).difference(known))
        if offsets:
            for word, x in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
                self.ids[word], self.spans[word] = np.array(x.ids, "<i4").tobytes(), np.array(x.offsets, "<i4").tobytes()
        else:
            inner = list(filter(_INNER.fullmatch, new))
            for a in range(0, len(inner), JOINED_WORDS):
                self._joined(inner[a : a + JOINED_WORDS])
            alone = [w for w in new if w not in self.ids]
            for word, x in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
                self.ids[word] = np.array(x.ids, "<i4").tobytes()
        return new if full else [w for w in new if len(w) > CACHE_CHARS]

    def encode(self, texts: list[str], offsets: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """The ids of each text (int32) and, if asked for, the start and end of each id's characters (rows of two).

        A character split over several ids is in the offsets of each of them. Pass texts of a bounded size together.
        """
        if any(len(t) > PIECE_CHARS for t in texts):
            for t in texts:
                pieces = cut(t)
                found = [next(self.encode([p], offsets)) for p in pieces]
                starts = np.cumsum([0, *map(len, pieces)])
                yield np.concatenate([x for x, _ in found]), np.concatenate([y + np.int32(a) for (_, y), a in zip(found, starts[:-1], strict=True)]) if offsets else None
            return
        words = [_WORD.findall(t) for t in texts]
        long = self._learn(words, offsets)
        for own in words:
            ids = np.frombuffer(b"".join(map(self.ids.__getitem__, own)), "<i4")
            if not offsets:
                yield ids, None
                continue
            found = [self.spans[w] for w in own]
            spans = np.frombuffer(b"".join(found), "<i4").reshape(-1, 2)
            starts = np.cumsum([0, *map(len, own)])[:-1]
            yield ids, spans + np.repeat(starts, [len(x) // 8 for x in found])[:, None].astype("<i4")
        for word in long:
            self.ids.pop(word, None)
            self.spans.pop(word, None)

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def decode(self, ids: Iterable[int]) -> str:
        """The text; bytes that are no whole character (ids cut within one) become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_stream(self, parts: Iterable[Iterable[int]]) -> Iterator[str]:
        """A text for each part; a character split between parts comes with the part that ends it."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in parts:
            yield decoder.decode(self.decode_bytes(ids))
        if rest := decoder.decode(b"", final=True):
            yield rest


def encode(df: DataFrame, text: str = "text", path: str | None = None, offsets: bool = False, keep: list[str] | None = None) -> DataFrame:
    """df's columns in `keep` (default: all) with ids array<int> and, if asked for, starts and ends array<int> (code points).

    A null text is encoded as the empty one: no ids. Rows are independent; repeated rows stay. Columns of df with the new
    names are replaced.
    """
    new = ["ids", *["starts", "ends"] * offsets]
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    model = df.sparkSession.sparkContext.broadcast(model_json(path or public_tokenizers.path(RANKS)))
    own = common.free_name(df, "own_text")
    read = df.select(*keep, common.text_or_empty(text).alias(own))
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(model.value)
        for batch in batches:
            for part in slices(batch, own):
                found = list(bpe.encode(part.column(own).to_pylist(), offsets))
                columns = [part.column(c) for c in keep] + [pa.array([x for x, _ in found], ints)]
                if offsets:
                    columns += [pa.array([spans[:, i] for _, spans in found], ints) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *new])
        del bpe
        release()

    schema = read.select(*keep).schema
    for name in new:
        schema = schema.add(name, T.ArrayType(T.IntegerType()))
    return common.to_python(read).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None, as_bytes: bool = False) -> DataFrame:
    """df with `decoded`: the text (or bytes) of its ids; null ids give the empty one. Ids outside the vocabulary are an error."""
    model = df.sparkSession.sparkContext.broadcast(model_json(path or public_tokenizers.path(RANKS)))
    rest = [c for c in df.columns if c.lower() != "decoded"]
    kind = pa.binary() if as_bytes else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(model.value)
        back = bpe.decode_bytes if as_bytes else bpe.decode
        for batch in batches:
            made = pa.array([back(x or ()) for x in batch.column(ids).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], made], names=[*rest, "decoded"])

    return common.to_python(df).mapInArrow(run, df.select(*rest).schema.add("decoded", "binary" if as_bytes else "string"))


def digests(df: DataFrame, text: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """df's columns in `keep` with n_tokens, ids_sha256 and decoded_sha256 of each text's ids, without sending the ids themselves."""
    new = ["n_tokens", "ids_sha256", "decoded_sha256"]
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    model = df.sparkSession.sparkContext.broadcast(model_json(path or public_tokenizers.path(RANKS)))
    own = common.free_name(df, "own_text")
    read = df.select(*keep, common.text_or_empty(text).alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(model.value)
        shown = [str(i) for i in range(len(bpe.tokens))]
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for part in slices(batch, own):
                rows = [(len(ids), digest(" ".join([shown[i] for i in ids]).encode()), digest(bpe.decode_bytes(ids))) for ids in (x.tolist() for x, _ in bpe.encode(part.column(own).to_pylist()))]
                n, a, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=[*keep, *new])
        del bpe
        release()

    return common.to_python(read).mapInArrow(run, read.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string"))


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir), keep=["doc_id"])
