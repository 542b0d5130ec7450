"""Operator 2: BPE encoding and decoding by dynamic programming over prefixes.

The tokens of a prefix are valid exactly when each neighbouring pair is: when merging the two side by side never
joins them. So each prefix has one last token, and it is found from shorter prefixes alone: an automaton over
the vocabulary's suffixes gives the tokens that end there, and the one that may follow the last token of the prefix before it is
kept. Following those back from the end gives the ids.

Pieces between white space encode on their own; each Python worker remembers a bounded number of them.

Defined results: a null text is empty; an empty text, or one of white space only, has no ids and decodes to the
empty text. Rows are taken as they come: repeated rows and null ids give a row each. Extra columns are ignored.
"""

from __future__ import annotations

import array
import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.llm.common import table

VOCABULARY = "word_bpe_49k.json"
#: Stands behind a piece for its end, which tokens may hold.
END = "Ā"
#: Pieces and pairs that a worker remembers before it starts afresh.
REMEMBERED = 400_000


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Encoder:
    """Tables of one vocabulary file, and the encoding and decoding by them."""

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        names = {i: t for t, i in vocab.items()}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names |= {i: t for t, i in self.special.items()}
        self.names: list[str] = [names.get(i, "") for i in range(max(names) + 1)]
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = dict.fromkeys(vocab.values(), -1)
        for k, (a, b) in enumerate(model["merges"]):
            left, right = vocab[a], vocab[b]
            whole = vocab[a + b]
            self.pair_rank[left, right] = k
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (left, right), k
        # matches tokens backwards from where they end: letter to next state, "" to the token read so far
        self.matches: dict = {}
        for t, i in vocab.items():
            body, end = (t[: -len(suffix)], END) if t.endswith(suffix) and t != suffix else (t, "")
            raw = "".join(chr(letters[c]) for c in body)
            # a single letter, or a token that its own merges lead to
            if len(body) == 1 or i in self.parts and self.pair_ok(*self.parts[i], self.rank[i]):
                state = self.matches
                for c in reversed(raw + end):
                    state = state.setdefault(c, {})
                state[""] = i
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split.replace(r"[^\s", r"[^\p{White_Space}")).findall
        self.splitter = Tokenizer.from_file(path)
        self.letters = letters
        self.around = regex.compile("|".join(f"({regex.escape(t)})" for t in self.special))
        self.follows: dict[int, bool] = {}
        self.known: dict[bytes, list[int]] = {}
        self.word: dict[bytes, bytes] = {}

    def pair_ok(self, a: int, b: int, until: int = 1 << 60) -> bool:
        """Whether a and b, side by side, stay apart through all merges ranked below until.

        Undo the later of the merges that made the two boundary tokens, again and again. Two boundary tokens lie
        side by side until the first of them is merged into what it was taken from; a merge of the two that ranks
        before that would have come first. Of equal merges the left one comes first.
        """
        rank, parts = self.rank, self.parts
        a_until, b_until = until, until - 1
        while True:
            k = self.pair_rank.get((a, b))
            if k is not None and k < a_until and k <= b_until:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                a_until, b_until = ra, ra - 1
                a = parts[a][1]
            else:
                a_until, b_until = rb + 1, rb
                b = parts[b][0]

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one piece, by the last token of each of its prefixes."""
        got = self.known.get(raw)
        if got is None:
            got = self.by_prefixes(raw)
            if len(raw) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[raw] = got
        return got

    def by_prefixes(self, raw: bytes) -> list[int]:
        text = raw.decode("latin-1") + END
        size = len(text)
        last, width = [-1] * (size + 1), [0] * (size + 1)
        follows, matches = self.follows, self.matches
        for end in range(1, size + 1):
            state, at = matches, end
            while at:
                at -= 1
                state = state.get(text[at])
                if state is None:
                    break
                token = state.get("")
                if token is None:
                    continue
                if at:
                    before = last[at]
                    if before < 0:
                        continue
                    key = before << 20 | token
                    ok = follows.get(key)
                    if ok is None:
                        if len(follows) >= REMEMBERED:
                            follows.clear()
                        ok = follows[key] = self.pair_ok(before, token)
                    if not ok:
                        continue
                last[end], width[end] = token, end - at
                break
        ids = []
        while size:
            ids.append(last[size])
            size -= width[size]
        return ids[::-1]

    def split(self, part: str) -> list[bytes]:
        """The pieces of a stretch, lower-cased.

        Beyond the first two Latin blocks the letters of Unicode versions differ; there the library splits.
        """
        if part.isascii():
            return [p.encode() for p in self.pieces(part.lower())]
        if max(part) < "ɐ":
            return [p.encode() for p in self.pieces(unicodedata.normalize("NFC", part).lower())]
        plain = self.splitter.normalizer.normalize_str(part)
        return [bytes(map(self.letters.__getitem__, p)) for p, _ in self.splitter.pre_tokenizer.pre_tokenize_str(plain)]

    def chunk(self, raw: bytes) -> bytes:
        """Ids of a stretch without ASCII white space, as unsigned 32-bit integers."""
        ids: list[int] = []
        text = raw.decode("utf-8")
        for part in self.around.split(text) if "<|" in text else (text,):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for piece in self.split(part):
                    ids += self.piece(piece)
        return array.array("I", ids).tobytes()

    def encode(self, text: bytes) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        known, chunk, out = self.word, self.chunk, []
        for w in text.split():
            got = known.get(w)
            if got is None:
                got = chunk(w)
                if len(w) <= 64:
                    if len(known) >= 2 * REMEMBERED:
                        known.clear()
                    known[w] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Without a decoder of its own the vocabulary's tokens are joined by spaces."""
        return " ".join(map(self.names.__getitem__, array.array("I", ids)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def digests(path: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path or default_path())
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column("text").cast(pa.large_binary()):
                ids = coder.encode(text.as_py() or b"")
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encoded(path: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path or default_path())
        for batch in batches:
            ids = [array.array("I", coder.encode(t.as_py() or b"")).tolist() for t in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return run


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and ids of each row's whole text."""
    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return kept.mapInArrow(encoded(path), "doc_id long, ids array<long>")


def decode_documents(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of each row's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path or default_path())
        for batch in batches:
            texts = [coder.decode(array.array("I", ids or []).tobytes()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encoding_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row's whole text."""
    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return kept.mapInArrow(digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"))
