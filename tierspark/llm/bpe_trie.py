"""BPE encoding and decoding by a traversal of a prefix-sharing trie.

A text is cut into words as the tokenizer's file says. The distinct words of a batch are inserted into a
trie. Byte-pair encoding has a useful property: the encoding of a prefix, without its last token, is the
encoding of the shorter prefix that is left. One token per trie node, the last one of that prefix, hence
describes the encoding of every prefix; it is found from the nodes above it, and a prefix that many words
share is encoded once.

The last token of a prefix is the vocabulary token that ends there and follows the last token of what
stands before it *compatibly*: merging the two tokens' symbols from scratch gives the two tokens again.
Compatible pairs are remembered.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tierspark.llm.common import arrow_map, pick, sliced

# Bounds of what a worker remembers; beyond them it starts anew.
MAX_PIECES = 400_000
MAX_WORDS = 300_000
MAX_PAIRS = 1_000_000
# Marks that are a word of their own behind letters; any other piece is cut by the rules below.
PLAIN_ENDS = (".", ",")

CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
WORDS = regex.compile(CONTRACTIONS + r"|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
BYTE_LEVEL = regex.compile(
    CONTRACTIONS
    + r"| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
SPACES = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
UNSAFE_SPACE = f"  |{SPACES} {SPACES}"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if visible, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Tokens and merges of a tokenizer file, and which tokens may follow each other."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        if model["type"] != "BPE":
            raise ValueError(f"{path}: not a BPE vocabulary")
        self._merges = model["merges"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.pairs: dict[int, bool] = {}
        self._bytes = dict(enumerate(byte_symbols()))
        self._space = self._bytes[32]

    # What only the trie needs is made when it is first used.

    @cached_property
    def inner(self) -> dict[str, int]:
        """Tokens by their symbols, without those that end a word where the vocabulary marks them."""
        return {t: i for t, i in self.ids.items() if not (self.end and t.endswith(self.end))}

    @cached_property
    def final(self) -> dict[str, int]:
        """Tokens that end a word, by their symbols."""
        return {t.removesuffix(self.end): i for t, i in self.ids.items() if t.endswith(self.end)} if self.end else self.inner

    @cached_property
    def width(self) -> dict[int, int]:
        return {i: len(t) for part in (self.inner, self.final) for t, i in part.items()}

    @cached_property
    def ranks(self) -> dict[tuple[str, str], int]:
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in self._merges]
        return {pair: rank for rank, pair in enumerate(pairs)}

    @property
    def size(self) -> int:
        return max(self.tokens) + 1

    def symbols(self, word: str) -> str:
        """A word as one printable character per byte."""
        if word.isascii() and word.isprintable():
            return word.replace(" ", self._space)
        return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._bytes)

    def merged(self, symbols: list[str]) -> list[str]:
        """The plain procedure on a few symbols: merge the best-ranked neighbours until none are left."""
        parts, never = list(symbols), len(self.ranks)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, never), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == never:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _split(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token.removesuffix(self.end)
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def follows(self, before: int, token: int) -> bool:
        """Whether ``token`` stays whole behind ``before`` (-1: nothing, at the start of a word)."""
        second = self.tokens[token]
        first = self.tokens[before] if before >= 0 else ""
        stays = (first, second) not in self.ranks and self.merged(self._split(first) + self._split(second)) == ([first, second] if first else [second])
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[(before << 32) + token] = stays
        return stays


class Trie:
    """Words inserted in sorted order: nodes are then made, and traversed, depth first.

    ``path[d]`` is the node of the current word's prefix of ``d`` symbols, ``last`` holds the last token
    of each node's prefix. The end of a word is a leaf of its own where the vocabulary marks word ends.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.last: list[int] = [-1]
        self.path: list[int] = [0]
        self.word = ""

    def _last_token(self, word: str, depth: int, vocabulary: dict[str, int]) -> int:
        """The one token that ends at ``depth`` and may follow what stands before it."""
        last, path, pairs = self.last, self.path, self.vocabulary.pairs
        for start in range(depth - 1, -1, -1):
            token = vocabulary.get(word[start:depth])
            if token is not None:
                before = last[path[start]]
                stays = pairs.get((before << 32) + token)
                if stays or stays is None and self.vocabulary.follows(before, token):
                    return token
        raise ValueError(f"the vocabulary has no token for {word[depth - 1]!r}")

    def insert(self, word: str) -> list[int]:
        """Add a word that is not before the last one in order, and return its ids."""
        vocabulary, path, last = self.vocabulary, self.path, self.last
        inner = len(word) - 1 if vocabulary.end else len(word)  # a marked last symbol is no prefix of anything
        shared, limit = 0, min(inner, len(path) - 1)
        while shared < limit and word[shared] == self.word[shared]:
            shared += 1
        del path[shared + 1 :]
        for depth in range(shared + 1, inner + 1):
            last.append(self._last_token(word, depth, vocabulary.inner))
            path.append(len(last) - 1)
        self.word = word
        found, left = [], len(word)
        if left > inner:
            found.append(self._last_token(word, left, vocabulary.final))
            left -= vocabulary.width[found[0]]
        while left:
            found.append(last[path[left]])
            left -= vocabulary.width[found[-1]]
        found.reverse()
        return found


def as_bytes(ids: list[int]) -> bytes:
    """Ids as unsigned 32-bit integers."""
    return array("I", ids).tobytes()


class Encoder:
    """Encodes batches of texts; each distinct piece of text is encoded once and remembered.

    A piece is what stands between spaces: every tokenizer rule for words stops at white space. The pieces
    of a batch are found and numbered by Arrow; only the distinct ones reach Python. With ``library`` the
    words of new pieces are encoded by the tokenizers library's model, else by the trie. ``keep`` is how many words
    may outlive the pieces they were found in; without it they go together.
    """

    def __init__(self, path: str, library: bool = False, keep: int = 0):
        self._keep = keep
        self.vocabulary = Vocabulary(path)
        self._specials = regex.compile("(" + "|".join(map(regex.escape, self.vocabulary.special)) + ")")
        self._model = Tokenizer.from_file(path).model if library else None
        self.forget()

    def forget(self, words: bool = True) -> None:
        """Let go of all pieces, at the end of a task or when there are too many, and of all words if asked for."""
        self._numbers: dict[str, int] = {}
        if words:
            self._words: dict[str, bytes] = {}
        self._ids, self._starts, self._lengths = array("I"), array("q"), array("q")
        pa.default_memory_pool().release_unused()  # idle workers wait for other tasks

    def _plain_words(self, piece: str) -> list[str]:
        if not self.vocabulary.end:
            body = piece[1:] if piece[:1] == " " else piece
            if body.isalpha():
                return [piece]
            if body[-1:] in PLAIN_ENDS and body[:-1].isalpha():
                return [piece[:-1], piece[-1]]
            return BYTE_LEVEL.findall(piece)
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece)
            if "Σ" in piece:  # lower case is taken letter by letter; Python alone looks at a sigma's neighbours
                piece = "".join(map(str.lower, piece))
        piece = piece.lower()
        if piece.isalpha():
            return [piece]
        if piece[-1:] in PLAIN_ENDS and piece[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return WORDS.findall(piece)

    def _piece_words(self, piece: str) -> list[str | bytes]:
        """The words of a piece; special tokens, which are looked for before anything else, as their ids."""
        special = self.vocabulary.special
        if "<" not in piece or not special:
            return self._plain_words(piece)
        words: list[str | bytes] = []
        for part in self._specials.split(piece):
            words += [as_bytes([special[part]])] if part in special else self._plain_words(part)
        return words

    def _learn_words(self, words: set[str]) -> None:
        symbols, known = self.vocabulary.symbols, self._words
        if self._model:
            for word in words:
                known[word] = as_bytes([token.id for token in self._model.tokenize(symbols(word))])
            return
        trie = Trie(self.vocabulary)
        for spelled, word in sorted([(symbols(word), word) for word in words]):
            known[word] = as_bytes(trie.insert(spelled))

    def numbers(self, pieces: list[str], whole: list[bool] | None = None) -> np.ndarray:
        """The number of each (distinct) piece, new ones encoded now. ``whole`` tells which are known to be one word."""
        if len(self._numbers) > MAX_PIECES:
            self.forget(words=not self._keep)
        if len(self._words) > (self._keep or MAX_WORDS):
            self._words = {}
        known, words = self._numbers, self._words
        if whole is None:
            cut = {piece: self._piece_words(piece) for piece in pieces if piece not in known}
        else:
            cut = {p: (p,) if one else self._piece_words(p) for p, one in zip(pieces, whole) if p not in known}
        self._learn_words({w for parts in cut.values() for w in parts if type(w) is str and w not in words})
        raw = [
            words[parts[0]] if len(parts) == 1 and type(parts[0]) is str
            else b"".join([words[word] if type(word) is str else word for word in parts])
            for parts in cut.values()
        ]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw)) // self._ids.itemsize
        self._starts.frombytes((len(self._ids) + np.cumsum(lengths) - lengths).tobytes())
        self._lengths.frombytes(lengths.tobytes())
        self._ids.frombytes(b"".join(raw))
        known.update(zip(cut, range(len(known), len(known) + len(raw))))
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(numbers, offsets)``: the piece numbers of all texts, and where those of each text begin."""
        # Nothing here refers to itself; Python's collector would only walk over all remembered pieces again and again.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._cut(texts)
        finally:
            if collects:
                gc.enable()

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        if self.vocabulary.end:
            lists = pc.ascii_split_whitespace(texts)
            coded = lists.flatten().dictionary_encode()
            pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            numbers = self.numbers(pieces)[coded.indices.to_numpy()]
            return numbers, lists.offsets.to_numpy().astype(np.int64)
        # A space belongs to what follows it. Where white space meets white space around a space, or none
        # can be cut off, the whole text is one piece.
        whole = pc.match_substring_regex(texts, UNSAFE_SPACE)
        if pc.any(whole).as_py():
            lists = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        else:
            lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        firsts = flat.take(offsets[:-1]).to_pylist()
        for at in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            firsts[at] = texts[at].as_py()
        # Arrow's own strings are many times faster to make by way of numpy.
        spaced = pc.binary_join_element_wise("", coded.dictionary, " ").to_numpy(zero_copy_only=False).tolist()
        one_word = pc.ascii_is_alpha(coded.dictionary).to_pylist() + [False] * len(firsts)
        found = self.numbers(spaced + firsts, one_word)
        numbers = found[: len(spaced)][coded.indices.to_numpy()]
        numbers[offsets[:-1]] = found[len(spaced) :]
        return numbers, offsets

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)``: the ids of all texts in one array, and where those of each text begin."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        numbers, offsets = self.cut(texts)
        lengths = np.frombuffer(self._lengths, np.int64)[numbers]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        shift = np.frombuffer(self._starts, np.int64)[numbers] - ends[:-1]
        places = np.arange(ends[-1]) + np.repeat(shift, lengths)
        return np.frombuffer(self._ids, np.uint32)[places] if len(places) else np.zeros(0, np.uint32), ends[offsets]

    def forms(self, numbers: np.ndarray) -> tuple[list[str], list[str], np.ndarray]:
        """Pieces as decimal ids and as decoded tokens, for the distinct ``numbers`` of a batch, and their places."""
        distinct, places = np.unique(numbers, return_inverse=True)
        tokens, ids, starts, lengths = self.vocabulary.tokens, self._ids, self._starts, self._lengths
        pieces = [ids[starts[n] : starts[n] + lengths[n]].tolist() for n in distinct.tolist()]
        return [" ".join(map(str, p)) for p in pieces], [" ".join([tokens[i] for i in p]) for p in pieces], places


@lru_cache(maxsize=1)
def encoder(path: str, library: bool = False, keep: int = 0) -> Encoder:
    """One encoder per worker and file."""
    return Encoder(path, library, keep)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", library: bool = False) -> DataFrame:
    """``(key, ids)``: the ids of every whole text as little-endian unsigned 32-bit integers.

    A NULL or empty text has no ids. Rows that repeat are encoded each for itself; no row is moved.
    """
    rows = pick(docs, **{key: key, "_text": text})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            ids, offsets = encoder(path, library).encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), as_binary(ids, offsets)], [key, "ids"])
        encoder(path, library).forget()

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, ids binary")


def as_binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Runs of a numeric array as binary values, without a copy."""
    places = (offsets * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(values)])


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``(key, tokens)``: the tokens of ``ids`` in their written form, with one space between them.

    That is what a vocabulary without a decoding rule defines. NULL ids count as none.
    """

    def each(columns: list[list]) -> list[list]:
        tokens = encoder(path).vocabulary.tokens
        return [columns[0], [" ".join([tokens[i] for i in memoryview(ids or b"").cast("I")]) for ids in columns[1]]]

    rows = pick(encoded, **{key: key, "ids": "ids"})
    return arrow_map(rows, each, f"`{key}` {rows.schema[key].dataType.simpleString()}, tokens string")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)`` of every whole text, encoded and decoded again.

    For a vocabulary without a decoding rule, whose decoded pieces are joined by a space as its tokens are.
    """
    rows = pick(docs, **{key: key, "_text": text})
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            coder = encoder(path)
            numbers, offsets = coder.cut(batch.column(1))
            ids, decoded, places = coder.forms(numbers)
            counts, of_ids, of_text = [], [], []
            bounds = offsets.tolist()
            for first, last in zip(bounds, bounds[1:]):
                own = places[first:last].tolist()
                text_ids = " ".join([ids[p] for p in own if ids[p]])
                text_tokens = " ".join([decoded[p] for p in own if ids[p]])
                counts.append(text_ids.count(" ") + 1 if text_ids else 0)
                of_ids.append(hashlib.sha256(text_ids.encode()).hexdigest())
                of_text.append(hashlib.sha256(text_tokens.encode()).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)]
            yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "ids_sha256", "decoded_sha256"])
        encoder(path).forget()

    return rows.mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
