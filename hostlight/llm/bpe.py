"""BPE encoding and decoding by forced-boundary splitting.

A merge only ever joins symbols into a token of the vocabulary. So a pair of neighbouring bytes that stands
inside no token can never be joined, and every such pair marks a certain cut: the fragments between cuts are
encoded independently and their ids concatenated. White space stands inside no token, so a whole text is first cut
at it; each fragment is then cut at the other pairs. Where the split pattern ends a word, the end mark is put on.

Work is done for a bounded slice of a batch at a time: all its new fragments are laid out as one array of bytes, cut
there, and the least-ranked pairs of all pieces are joined in rounds (a merge's result only takes part in merges of
higher rank, so all places of a piece's least rank can be joined at once). A long piece is joined with a heap over a
linked list instead, in n log n steps. Short fragments repeat, so each task remembers a bounded number of them.

The text rules (special tokens first, NFC, white space runs to one space, lower case character by character,
the split pattern, byte-to-character map, word end) are read from the tokenizer file.

Defined results: a null text counts as empty and gives no ids and an empty decoded text. Repeated rows are
encoded alike, an empty table gives an empty table, texts of any length are encoded whole. Only the key and the text
are read, so other columns may have any name. Of pairs with the same rank the first is joined first.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, release, table


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def lower(text: str) -> str:
    """Lower case of each character by itself (a final sigma gets no form of its own)."""
    return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()


#: Separators that `str.split` takes for white space and the pattern doesn't.
_NOT_SPACE = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\s+")
#: Longest fragment that is remembered, and longest piece that is joined in rounds with the others.
SHORT, LONG = 48, 200
_NEVER = np.int32(1 << 30)


class Codec:
    """Encodes and decodes with one vocabulary file; about `remembered` fragments are kept."""

    def __init__(self, spec: str, remembered: int = 150_000):
        j = json.loads(spec)
        model = j["model"]
        if model["type"] != "BPE" or j["decoder"] is not None:
            raise ValueError("a BPE vocabulary without decoder is needed")
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        #: rank of a merge by its two ids in one number, and the id it makes
        self.ranks = {a << 32 | b: k for k, (a, b, _) in enumerate(merges)}
        self.makes = [c for _, _, c in merges]
        made = {c: k for k, c in enumerate(self.makes)}
        if len(made) < len(merges) or any(max(made.get(a, -1), made.get(b, -1)) >= k for k, (a, b, _) in enumerate(merges)):
            raise ValueError("a token must be made by one merge, of tokens made before it")
        self._pairs = np.array(sorted(self.ranks), np.int64)
        self._pair_rank = np.array([self.ranks[x] for x in self._pairs.tolist()], np.int32)
        self._makes = np.array(self.makes, np.int32)
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.names = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = t
        split = next(p for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        char = byte_characters()
        byte = {c: b for b, c in enumerate(char)}
        #: id of each byte inside a word and at its end, and which pairs of bytes stand inside a token
        self.alone, self.last = (np.array([vocab[c + e] for c in char], np.int32) for e in ("", end))
        self.inside = np.zeros((256, 256), bool)
        for t in vocab:
            body = [byte[c] for c in t.removesuffix(end)]
            self.inside[body[:-1], body[1:]] = True
        self.remembered = remembered
        #: fragments with their ids as bytes and their decoded text; special tokens stand under a key with a space
        self.fixed = {" " + t: (i.to_bytes(4, "little"), t) for t, i in self.special.items()}
        self.known: dict[str, tuple[bytes, str]] = dict(self.fixed)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, `_NEVER` where they aren't joined."""
        pair = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
        return np.where(self._pairs[at] == pair, self._pair_rank[at], _NEVER)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and where the ids of each word end."""
        ends = np.cumsum([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        ids = self.alone[data]
        ids[ends - 1] = self.last[data[ends - 1]]
        first = np.ones(len(data), bool)  # a piece begins here: at a forced cut, or with its word
        first[1:] = ~self.inside[data[:-1], data[1:]]
        first[ends[:-1]] = True
        out = np.full(len(data), -1, np.int32)
        begins = np.flatnonzero(first)
        sizes = np.diff(begins, append=len(data))
        for k in np.flatnonzero(sizes > LONG):
            found = self.merged_by_heap(ids[begins[k] : begins[k] + sizes[k]].tolist())
            out[begins[k] : begins[k] + len(found)] = found
        use = np.repeat(sizes <= LONG, sizes)
        self._in_rounds(ids[use], first[use], np.flatnonzero(use), out)
        return out[out >= 0], np.cumsum(out >= 0)[ends - 1]

    def _in_rounds(self, ids: np.ndarray, first: np.ndarray, place: np.ndarray, out: np.ndarray) -> None:
        """Joins the pieces of `ids` that begin at `first`, and puts what is left into `out` at its place."""
        ranks = np.full(len(ids), _NEVER)  # of each symbol with the next one of its piece
        pairs = np.flatnonzero(~first[1:])
        ranks[pairs] = self.rank(ids[pairs], ids[pairs + 1])
        while len(ids):
            begins = np.flatnonzero(first)
            least = np.minimum.reduceat(ranks, begins)
            sizes = np.diff(begins, append=len(ids))
            if (least == _NEVER).any():
                more = np.repeat(least != _NEVER, sizes)
                out[place[~more]] = ids[~more]
                ids, first, place, ranks = ids[more], first[more], place[more], ranks[more]
                sizes, least = sizes[least != _NEVER], least[least != _NEVER]
                if not len(ids):
                    return
            hit = ranks == np.repeat(least, sizes)
            if (hit[1:] & hit[:-1]).any():  # a symbol repeats: join the first with the second, the third with the fourth
                at = np.arange(len(hit))
                run = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), at, 0))
                hit &= (at - run) % 2 == 0
            ids[hit] = self._makes[ranks[hit]]
            keep = np.ones(len(ids), bool)
            keep[1:] = ~hit[:-1]
            fresh = hit[keep]
            ids, first, place, ranks = ids[keep], first[keep], place[keep], ranks[keep]
            follows = np.concatenate([~first[1:], [False]])
            changed = follows & (fresh | np.concatenate([fresh[1:], [False]]))
            ranks[fresh] = _NEVER
            at = np.flatnonzero(changed)
            ranks[at] = self.rank(ids[at], ids[at + 1])

    def merged_by_heap(self, ids: list[int]) -> list[int]:
        """Ids of one piece of any length: the next pair comes from a heap ordered by rank, then place."""
        n, get = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        line = [r << 40 | k for k in range(n - 1) if (r := get(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(line)
        while line:
            rank, a = divmod(heapq.heappop(line), 1 << 40)
            b = after[a]
            if ids[a] < 0 or b >= n or get(ids[a] << 32 | ids[b]) != rank:
                continue  # one of the two has been joined since
            ids[a], ids[b] = self.makes[rank], -1
            after[a] = c = after[b]
            if c < n:
                before[c] = a
                if (r := get(ids[a] << 32 | ids[c])) is not None:
                    heapq.heappush(line, r << 40 | a)
            if (z := before[a]) >= 0 and (r := get(ids[z] << 32 | ids[a])) is not None:
                heapq.heappush(line, r << 40 | z)
        return [i for i in ids if i >= 0]

    def learn(self, fragments: list[str]) -> None:
        """Puts ids and decoded text of each fragment (normalised text without white space) into `known`."""
        split, words, counts = self.pattern.findall, [], []
        for f in fragments:
            if f.isascii() and f.isalpha():
                words.append(f.encode())
                counts.append(1)
            else:
                found = split(f)
                words += [w.encode("utf-8", "surrogatepass") for w in found]
                counts.append(len(found))
        if not words:
            return
        ids, ends = self.merged(words)
        at = np.concatenate([[0], ends])[np.cumsum([0, *counts])].tolist()
        data, names = ids.astype("<u4").tobytes(), [self.names[i] for i in ids.tolist()]
        self.known.update({f: (data[4 * at[k] : 4 * at[k + 1]], " ".join(names[at[k] : at[k + 1]])) for k, f in enumerate(fragments)})

    def normal(self, text: str) -> str:
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return lower(text)

    def fragments(self, text: str) -> list[str]:
        """A text between its runs of white space."""
        return _SPACE.split(text.strip(" ")) if _NOT_SPACE.search(text) else text.split()

    def parts(self, text: str) -> list[str]:
        """Fragments and special tokens (with a space before) of a text."""
        out = []
        for k, part in enumerate(self.special_pattern.split(text)):
            if k % 2:
                out.append(" " + part)
            elif part:
                out += self.fragments(self.normal(part))
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Ids as bytes, and the decoded text (tokens joined by spaces), of each text."""
        parts = [self.parts(t) if t else [] for t in texts]
        seen = set().union(*parts)
        fresh = list(seen - self.known.keys())
        self.learn(fresh)
        known, out = self.known, []
        for p in parts:
            found = [known[f] for f in p]
            out.append((b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[1]])))
        for f in fresh:
            if len(f) > SHORT:
                del self.known[f]
        if len(self.known) > self.remembered:
            self.known = self.fixed | {f: known[f] for f in seen if len(f) <= SHORT}
        return out

    def decode(self, ids: bytes) -> str:
        return " ".join([self.names[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode(docs: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """One row per row of `docs`: the key, `ids` (array of int) and `decoded`."""
    return _coded(docs, key, text, vocabulary, "ids array<int>, decoded string", lambda ids, shown: {"ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in ids], "decoded": shown})


def _digests(ids: list[bytes], shown: list[str]) -> dict:
    return {
        "n_tokens": [len(x) // 4 for x in ids],
        "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
        "decoded_sha256": [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in shown],
    }


def encode_digests(docs: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """As `encode`, but with the number of ids and digests of ids and decoded text."""
    return _coded(docs, key, text, vocabulary, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)


def _coded(docs: DataFrame, key: str, text: str, vocabulary: str, schema: str, made) -> DataFrame:
    spec = Path(vocabulary).read_text()  # a file of fixed size; it goes out with the function

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(spec)
        for pdf in batches:
            for part in chunks(pdf["text"]):
                both = codec.encode([t if isinstance(t, str) else None for t in pdf["text"][part]])
                yield pd.DataFrame({"key": pdf["key"][part], **made([b[0] for b in both], [b[1] for b in both])})
        del codec
        release()

    kind = docs.schema[key].dataType.simpleString()
    out = docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInPandas(run, f"key {kind}, {schema}")
    return out.withColumnRenamed("key", key)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary_path())
