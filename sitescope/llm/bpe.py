"""Operator 5: exact BPE by dynamic programming over prefixes, and decoding.

Of all segmentations of a prefix only one is what BPE yields, and it is the one whose neighbouring tokens are all
compatible: two tokens are compatible if BPE, run on their joined symbols, gives back the two. So for every prefix there
is one last token, and it is stored: among the vocabulary's tokens that end there (found by an Aho-Corasick automaton of
the vocabulary, which at each place lists the tokens that are suffixes of what was read) it is the one that is compatible
with the last token of the prefix before it. Back-pointers then give the ids. No merge loop runs over texts.

Two tokens are incompatible if some symbol on the right edge of the first and some on the left edge of the second, both
made before either is used up by an inner merge, would have merged with each other.

Letters, numbers and white space are told apart by Python's tables; a text with characters that these do not know is
normalized and split by the vocabulary's own normalizer and splitter, so that newer characters are treated as there.

Null texts count as empty; they have no tokens. Repeated rows get equal results, null ids stay null, an empty table gives
no rows. Texts are taken in slices of bounded bytes; a word needs about 10 bytes a byte, however long it is.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from sitescope.llm import common

#: Words whose ids a worker remembers; beyond that it forgets all and starts anew.
CACHE_WORDS = 400_000
_END = "</w>"
_LAST = "\x00"  # stands for the end-of-word mark behind a word's last symbol
_INF = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
    hidden = [c for c in range(256) if c not in set(shown)]
    table = [""] * 256
    for c in shown:
        table[c] = chr(c)
    for k, c in enumerate(hidden):
        table[c] = chr(256 + k)
    return table


class WordBpe:
    """Encoder and decoder for a vocabulary file with word ends (kind ``BPE``, byte-level, end-of-word suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["end_of_word_suffix"] != _END or spec["decoder"] is not None:
            raise ValueError("not a vocabulary with word ends")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.piece = regex.compile(split.replace(r"[^\s", r"[^\t-\r \x85\xa0  -     　"))
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for k, (a, b) in enumerate(merges):
            left, right, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[left, right] = k
            if whole not in self.made:
                self.made[whole], self.parts[whole] = k, (left, right)
        self.table = str.maketrans({c: t for c, t in enumerate(byte_alphabet())})
        self.automaton = ahocorasick.Automaton()
        for text, i in self.vocab.items():
            if text in self.special:
                continue
            plain = text[: -len(_END)] + _LAST if text.endswith(_END) and len(text) > len(_END) else text
            if i < 512 or i in self.made:
                self.automaton.add_word(plain, (len(plain), i))
        self.automaton.make_automaton()
        self.path, self._library = path, None
        self._fits: dict[int, bool] = {}
        self._left: dict[int, list] = {}
        self._right: dict[int, list] = {}
        self._words: dict[str, tuple[int, ...]] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(symbol, rank of the merge that uses it up) along one edge of a token, outermost first."""
        out, used = [(token, _INF)], token
        while used in self.parts:
            inner = self.parts[used][side]
            out.append((inner, self.made[used]))
            used = inner
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves the border between two tokens alone."""
        key = a << 20 | b
        known = self._fits.get(key)
        if known is None:
            right = self._right.get(a) or self._right.setdefault(a, self._edge(a, 1))
            left = self._left.get(b) or self._left.setdefault(b, self._edge(b, 0))
            rank, known = self.rank, True
            for x, x_used in right:
                for y, y_used in left:
                    k = rank.get((x, y))
                    # of equal ranks the leftmost merge goes first
                    if k is not None and k < x_used and k <= y_used:
                        known = False
                        break
                if not known:
                    break
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            self._fits[key] = known
        return known

    def encode_symbols(self, word: str) -> list[int]:
        """Ids of one pre-token in the byte alphabet (non-empty)."""
        n = len(word)
        last = array("i", [-1]) * (n + 2)
        size = array("H", [0]) * (n + 2)
        last[0] = -2
        known, fits = self._fits, self.fits
        for end, (length, token) in self.automaton.iter(word + _LAST):
            end += 1
            # the last symbol bears the end mark: no token ends before the mark
            if end == n or last[end] != -1:
                continue
            before = last[end - length]
            if before == -1:
                continue
            if before != -2:
                ok = known.get(before << 20 | token)
                if ok is None:
                    ok = fits(before, token)
                if not ok:
                    continue
            last[end], size[end] = token, length
        out, at = [], n + 1
        if last[at] == -1:
            raise ValueError(f"no segmentation of {word!r}")
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def normalize(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower-cased letter by letter, without the final form
                text = text.replace("Σ", "σ")
        return text.lower()

    def library_symbols(self, text: str) -> list[str]:
        """Pre-tokens in the byte alphabet, by the vocabulary's own normalizer and splitter."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return [symbols for symbols, _ in self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        words = self._words
        pieces = self.marks.split(text) if "<|" in text else (text,)
        for piece in pieces:
            if piece in self.special:
                out.append(self.special[piece])
                continue
            if not piece.isascii() and any(unicodedata.category(c) == "Cn" for c in set(piece)):
                for symbols in self.library_symbols(piece):
                    out += self.encode_symbols(symbols)
                continue
            for word in self.piece.findall(self.normalize(piece)):
                ids = words.get(word)
                if ids is None:
                    symbols = word if word.isascii() and word.isprintable() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table)
                    ids = tuple(self.encode_symbols(symbols))
                    if len(word) <= 40:
                        if len(words) >= CACHE_WORDS:
                            words.clear()
                        words[word] = ids
                out += ids
        return out

    def decode(self, ids) -> str:
        """Tokens joined by a space, special ones included: this kind of vocabulary names no decoder."""
        texts = self.texts
        return " ".join([texts[i] for i in ids])


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One encoder a worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def vocabulary(name: str) -> str:
    """Path of a vocabulary file; resolved in each worker, as nothing is shared but inputs."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, name: str = "word_bpe_49k.json") -> DataFrame:
    """(doc_id, ids, decoded): the ids of each text and the text that they decode to."""

    def run(batches):
        bpe = load(vocabulary(name))
        for batch, texts in common.slices(batches):
            ids = [bpe.encode(t.decode("utf-8", "surrogatepass")) for t in texts]
            yield common.with_columns(batch, ("doc_id",), ids=pa.array(ids, pa.list_(pa.int32())), decoded=pa.array([bpe.decode(x) for x in ids], pa.string()))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(docs: DataFrame, name: str = "word_bpe_49k.json") -> DataFrame:
    """As encode_documents(), with hashes in place of ids and texts: these never leave the worker."""

    def run(batches):
        bpe = load(vocabulary(name))
        for batch, texts in common.slices(batches):
            n, of_ids, of_text = [], [], []
            for t in texts:
                ids = bpe.encode(t.decode("utf-8", "surrogatepass"))
                n.append(len(ids))
                of_ids.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield common.with_columns(batch, ("doc_id",), n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(of_ids, pa.string()), decoded_sha256=pa.array(of_text, pa.string()))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.read(spark, sf_dir, "documents"))


QUERIES = {"op5_bpe": op5_bpe}
ORACLE_SQL: dict[str, str] = {}
