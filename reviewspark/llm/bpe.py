"""BPE encoding and decoding with a compiled lexicon of frequent words.

Words are counted over all documents; the most frequent ones are encoded once and compiled into a
minimal acyclic automaton (suffixes shared, transitions carry word counts, so that walking a word
yields its number and the number its ids). The automaton is a flat block of bytes of bounded size that
tasks map into memory; a word it does not hold is merged exactly, by the rank of its pairs. The
results equal those of the tokenizers library for the same file, whatever the lexicon holds.

Supported files: byte-level BPE with a suffix on the last piece of a word, NFC, white space and lower
case as normalizers, a pattern that keeps its matches, special tokens matched in the raw text, no
decoder (tokens are joined by a blank). The file is a parameter and is read by the driver alone.

Defined results: a null text counts as empty and has no tokens; repeated rows give repeated results;
very long words are merged in n log n; an empty table gives an empty table; columns beside the key and
the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewspark.llm.common import mapped

LEXICON_WORDS = 65_536
#: Chunks (and words) of text that a task remembers per generation: bounds its memory, not its results.
REMEMBERED = 150_000
LONG_WORD = 48


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    others = [b for b in range(256) if b not in letters]
    return [letters.get(b) or chr(256 + others.index(b)) for b in range(256)]


class Merges:
    """Vocabulary and merge ranks of one tokenizer file; encodes a word by exact merging."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        #: rank of a pair, and by rank the id that it becomes
        self.ranks = {(self.vocab[a], self.vocab[b]): rank for rank, (a, b) in enumerate(model["merges"])}
        self.merged = [self.vocab[a + b] for a, b in model["merges"]]
        letters = byte_letters()
        self.inner = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + self.suffix] for x in letters]

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: the pair of the lowest rank, leftmost first, is merged until none is left."""
        ids = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        rank, none = self.ranks.get, len(self.merged)
        ranks = [rank(p, none) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i:i + 2] = [self.merged[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list."""
        n, rank = len(ids), self.ranks.get
        left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = right[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = self.merged[best], False, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            for x in (left[i], i):
                y = right[x] if x >= 0 else -1
                if y >= 0 and (r := rank((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x, keep in zip(ids, alive) if keep]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """Minimal acyclic automaton of the words, as bytes.

    Words come in order; the part of the last word's path that the next word leaves is frozen, and a
    frozen state equal to an earlier one is replaced by it, so suffixes are shared. Each transition
    holds how many words sort before it at its state: their sum along a word is the word's number.
    """
    words = sorted(w for w in entries if w)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    path: list[list] = [[False, []]]

    def freeze(node):
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    previous = b""
    for word in [*words, None]:
        same = 0 if word is None else len(os.path.commonprefix([previous, word]))
        while len(path) - 1 > same:
            node = path.pop()
            path[-1][1].append((previous[len(path) - 1], freeze(node)))
        if word is None:
            break
        for _ in word[same:]:
            path.append([False, []])
        path[-1][0] = True
        previous = word
    root = freeze(path[0])

    below = [0] * len(states)
    first, labels, targets, before = [0], [], [], []
    for s, (final, edges) in enumerate(states):  # targets are frozen before their sources
        count = int(final)
        for label, target in edges:
            labels.append(label)
            targets.append(target)
            before.append(count)
            count += below[target]
        below[s] = count
        first.append(len(labels))
    ids = [entries[w] for w in words]
    ends = np.cumsum([len(x) for x in ids], dtype=np.int32) if ids else np.zeros(0, np.int32)
    parts = [np.array([root], np.int32), np.array([f for f, _ in states], np.int32), np.array(first, np.int32), np.array(labels, np.int32),
             np.array(targets, np.int32), np.array(before, np.int32), np.concatenate([[0], ends]).astype(np.int32), np.array([x for y in ids for x in y], np.int32)]
    head = np.array([len(p) for p in parts], np.int32)
    return b"".join(p.tobytes() for p in [head, *parts])


class Lexicon:
    """A compiled automaton, mapped from a file of the task's own."""

    def __init__(self, block: bytes):
        with tempfile.NamedTemporaryFile(prefix="lexicon-", delete=False) as f:
            f.write(block)
        data = np.memmap(f.name, dtype=np.int32, mode="r")
        os.unlink(f.name)  # the mapping keeps it
        parts, at = [], 8
        for n in data[:8]:
            parts.append(memoryview(data[at:at + n]))
            at += int(n)
        self.root, self.final, self.first, self.labels, self.targets, self.before, self.ends, self.ids = parts

    def find(self, word: bytes) -> list[int] | None:
        state, number, labels = self.root[0], 0, self.labels
        for b in word:
            for e in range(self.first[state], self.first[state + 1]):
                if labels[e] == b:
                    number += self.before[e]
                    state = self.targets[e]
                    break
            else:
                return None
        return list(self.ids[self.ends[number]:self.ends[number + 1]]) if self.final[state] else None


class Encoder:
    """Texts to (ids as text, decoded text, number of tokens), chunk by chunk.

    No token spans white space, so a text is the sequence of its chunks between white space, and a
    chunk is encoded once and remembered.
    """

    def __init__(self, merges: Merges, lexicon: Lexicon | None):
        self.merges, self.lexicon = merges, lexicon
        self.forget()
        self.pieces = regex.compile(merges.pattern)
        self.special = re.compile("|".join(re.escape(x) for x in sorted(merges.special, key=len, reverse=True))) if merges.special else None
        self.marks = tuple(merges.special)
        # str.split() also splits at U+001C to U+001F, which are not white space to the tokenizer
        self.odd = re.compile("[\x1c-\x1f]")
        self.white = re.compile("[\t-\r \x85\xa0  -     　]+")

    def forget(self) -> None:
        """Drop what is remembered; two generations each, so that what is in use outlives a full one."""
        self.chunks, self.old_chunks, self.words, self.old_words = {}, {}, {}, {}

    def word(self, piece: str) -> list[int]:
        found = self.old_words.get(piece)
        if found is None:
            found = self.encoded(piece)
        if len(self.words) >= REMEMBERED:
            self.words, self.old_words = {}, self.words
        self.words[piece] = found
        return found

    def encoded(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        found = self.lexicon.find(raw) if self.lexicon else None
        if found is None:
            found = self.merges.merge(raw)
        return found

    def chunk(self, chunk: str) -> tuple[str, str, int]:
        out = self.old_chunks.get(chunk) or self.encoded_chunk(chunk)
        if len(self.chunks) >= REMEMBERED:
            self.chunks, self.old_chunks = {}, self.chunks
        self.chunks[chunk] = out
        return out

    def encoded_chunk(self, chunk: str) -> tuple[str, str, int]:
        plain = unicodedata.normalize("NFC", chunk)
        plain = plain.lower() if plain.isascii() else "".join(c.lower() for c in plain)
        tokens = self.merges.tokens
        ids = [i for p in self.pieces.findall(plain) for i in self.words.get(p) or self.word(p)]
        return " ".join(map(str, ids)), " ".join([tokens[i] for i in ids]), len(ids)

    def split(self, text: str) -> list[str]:
        return [c for c in self.white.split(text) if c] if self.odd.search(text) else text.split()

    def text(self, text: str) -> tuple[str, str, int]:
        if self.special and any(m in text for m in self.marks):
            found, at = [], 0
            for m in self.special.finditer(text):
                found += [self.chunks.get(c) or self.chunk(c) for c in self.split(text[at:m.start()])]
                i = self.merges.special[m.group(0)]
                found.append((str(i), m.group(0), 1))
                at = m.end()
            found += [self.chunks.get(c) or self.chunk(c) for c in self.split(text[at:])]
        else:
            found = [self.chunks.get(c) or self.chunk(c) for c in self.split(text)]
        return " ".join([x[0] for x in found]), " ".join([x[1] for x in found]), sum([x[2] for x in found])


def frequent_words(docs: DataFrame, text: str = "text", words: int = LEXICON_WORDS) -> list[str]:
    """The most frequent lower-case words, counted over all documents; at most ``words`` reach the driver."""
    pieces = docs.select(F.explode(F.split(F.lower(docs[text].cast("string")), r"[^\p{L}]+")).alias("w")).where("w <> ''")
    counts = pieces.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return [r["w"] for r in counts.orderBy(F.col("n").desc(), "w").limit(words).collect()]


def build_lexicon(merges: Merges, words: list[str]) -> bytes:
    return compile_lexicon({raw: merges.merge(raw) for w in words if (raw := w.encode("utf-8", "surrogatepass"))})


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", words: int = LEXICON_WORDS, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with ``ids`` and ``decoded`` too if asked for."""
    spark = docs.sparkSession
    model = Merges(path)
    merges = spark.sparkContext.broadcast(model)
    block = spark.sparkContext.broadcast(build_lexicon(model, frequent_words(docs, text, words)))
    rows = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(merges.value, Lexicon(block.value))
        for batch in batches:
            out: dict[str, list] = {"n": [], "a": [], "b": [], "ids": [], "decoded": []}
            for value in batch.column("text"):
                ids, decoded, n = encoder.text(value.as_py())
                out["n"].append(n)
                out["a"].append(hashlib.sha256(ids.encode()).hexdigest())
                out["b"].append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    out["ids"].append([int(x) for x in ids.split()])
                    out["decoded"].append(decoded)
            columns = [batch.column("doc_id"), pa.array(out["n"], pa.int64()), pa.array(out["a"], pa.string()), pa.array(out["b"], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["decoded"], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    extra = ", ids array<int>, decoded string" if with_ids else ""
    return mapped(rows, run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{extra}")
