"""Spelling variants by reduced-alphabet generation.

Letters are hashed to a few symbols. Words that differ by one edit have reduced words that are equal or differ
by one edit, so the full one-edit neighbourhood of every reduced word is generated and joined with the reduced
vocabulary: over few symbols it is small, whatever the alphabet is. Words behind a joined pair are verified on
the original strings.

Reduced words are known by a position-weighted hash modulo two primes, from which the hash of every edit
follows without building the edited string; a very long word costs a few numbers per letter. A clash of two
hashes only adds a candidate. A bitmap over the reduced vocabulary, of bounded size, drops most generated
neighbours before the exchange; the join is exact. Reduced words that stand for many words are not paired
with anything: their words and those next to them go on to a larger alphabet, at last to all letters, where a
reduced word is the word itself.

Defined results: null texts have no words; a null id is an empty text in the checksum that damages words;
repeated rows count as often as they occur; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewspark.llm.common import mapped, stored
from reviewspark.scale import spread

LEAST_LETTERS = 7
LEAST_OCCURRENCES = 2
#: A word's form occurs at least so many times as often.
RATIO = 10
#: Symbols by level; the last level is the alphabet itself.
SYMBOLS = (6, 24, None)
#: Words of one reduced word, at most, that are paired at a level.
BUCKET = 32
#: Bits per reduced word of the bitmap, and its bits at most (32 MB).
BITS_PER_WORD, MOST_BITS = 32, 1 << 28
#: Neighbours made at once.
MADE = 1_000_000

LETTERS = np.array([*range(97, 123), *range(192, 256)])
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)


def damaged(run: Column, doc_id: Column) -> Column:
    """The run, or the run without one letter where the checksum of id and run is divisible by 31."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(h, F.lit(31)) == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, least: int = LEAST_LETTERS, occurrences: int = LEAST_OCCURRENCES) -> DataFrame:
    """(word, n) of all texts; runs shorter than a word never leave the scan."""
    runs = F.regexp_extract_all(docs["text"].cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))
    upper = "".join(map(chr, range(65, 91)))
    found = docs.select(docs["doc_id"].alias("doc_id"), F.explode(runs).alias("run")).select("doc_id", F.translate("run", upper, upper.lower()).alias("run"))
    words = found.select(damaged(F.col("run"), F.col("doc_id")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= occurrences)


def alphabet(symbols: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(symbol of every letter by code point, the symbols): letters dealt by a multiplicative hash."""
    table = np.zeros(256, np.int64)
    table[LETTERS] = LETTERS if symbols is None else 1 + (LETTERS * 40503 % 65536) * symbols // 65536
    return table, np.unique(table[LETTERS])


def prefix_hashes(codes: np.ndarray, prime: int, base: int):
    """(running hashes, powers, prime, base, its inverse) of words of one length."""
    length = codes.shape[1]
    powers = np.empty(length + 1, np.int64)
    powers[0] = 1
    done = 1
    while done <= length:  # powers by doubling: a very long word is no loop over letters
        step = min(done, length + 1 - done)
        powers[done:done + step] = powers[:step] * pow(base, done, prime) % prime
        done += step
    sums = np.zeros((len(codes), length + 1), np.int64)
    np.cumsum(codes * powers[:length] % prime, axis=1, out=sums[:, 1:])
    return sums % prime, powers, prime, base, pow(base, -1, prime)


def joined(parts: list[np.ndarray]) -> np.ndarray:
    return (parts[0] << 31) | parts[1]


def ids_of(codes: np.ndarray) -> np.ndarray:
    return joined([prefix_hashes(codes, p, b)[0][:, -1] for p, b in zip(PRIMES, BASES)])


def neighbourhood(codes: np.ndarray, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, id) of all words one edit away from the rows of ``codes``, each once, some positions at a time."""
    length = codes.shape[1]
    hashes = [prefix_hashes(codes, p, b) for p, b in zip(PRIMES, BASES)]
    step = max(1, MADE // (2 * len(codes) * len(symbols)))
    for lo in range(0, length + 1, step):
        hi, end = min(lo + step, length + 1), min(lo + step, length)
        own = codes[:, lo:end, None]
        # in a run of equal symbols, deleting any or inserting one more at any place gives the same word
        before = codes[:, lo - 1:hi - 1] if lo else np.concatenate([np.zeros((len(codes), 1), np.int64), codes[:, :hi - 1]], axis=1)
        made: list[list[np.ndarray]] = [[], [], []]
        for sums, powers, prime, base, inverse in hashes:
            total = sums[:, length:]
            made[0].append((sums[:, lo:end] + (total - sums[:, lo + 1:end + 1]) % prime * inverse) % prime)
            made[1].append((total[:, :, None] + (symbols - own) % prime * powers[lo:end, None]) % prime)
            moved = (total - sums[:, lo:hi]) % prime * base % prime
            made[2].append((sums[:, lo:hi, None] + symbols * powers[lo:hi, None] + moved[:, :, None]) % prime)
        for kind, new in zip(made, (codes[:, lo:end] != before[:, :end - lo], symbols != own, symbols != before[:, :, None])):
            yield np.nonzero(new)[0], joined(kind)[new]


def by_length(words: list[str], table: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, symbols) of words of one length, about ``MADE`` neighbours at a time."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        places = np.flatnonzero(lengths == n)
        step = max(1, MADE // int(n * width * 2))
        for lo in range(0, len(places), step):
            part = places[lo:lo + step]
            yield part, table[np.frombuffer("".join(words[i] for i in part).encode("latin-1"), np.uint8).reshape(len(part), n)]


def keyed(words: DataFrame, symbols: int | None) -> DataFrame:
    """(word, n, id): the id of every word's reduced word."""
    table, kinds = alphabet(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.zeros(len(b), np.int64)
            for places, codes in by_length(b.column("word").to_pylist(), table, len(kinds)):
                ids[places] = ids_of(codes)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(ids)], ["word", "n", "id"])

    return mapped(words.select("word", "n"), run, "word string, n long, id long")


def occupied(ids: DataFrame, bits: int) -> np.ndarray:
    """Bitmap over the hashed ids, built by aggregation; its size does not grow beyond ``MOST_BITS``."""
    slot = F.pmod(F.col("id"), F.lit(bits)) + 1
    found = ids.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("m")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    for b, m in zip(found.column("b").to_pylist(), found.column("m").to_pylist()):
        out[(b - 1) * 4096:(b - 1) * 4096 + len(m)] = np.frombuffer(m, np.uint8)[:len(out) - (b - 1) * 4096]
    return out


def reduced_pairs(words: DataFrame, symbols: int | None) -> DataFrame:
    """(a, b), a < b: ids of reduced words one edit apart that may both be in the vocabulary.

    ``words``: word, id. One word stands for all that reduce alike; the reduced word itself is part of the key,
    so that words whose ids clash all get their neighbours.
    """
    table, kinds = alphabet(symbols)
    letters, codes = "".join(map(chr, LETTERS)), "".join(chr(c) for c in table[LETTERS] + 64)
    single = words.groupBy("id", F.translate("word", letters, codes).alias("reduced")).agg(F.min("word").alias("word"))
    single = stored(single.select("id", "word"), "spelling-reduced")
    n = max(1, single.count())
    bits = int(min(MOST_BITS, max(1 << 15, 1 << int(np.ceil(np.log2(n * BITS_PER_WORD))))))
    shared = words.sparkSession.sparkContext.broadcast(occupied(single, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for b in batches:
            for _, codes in by_length(b.column("word").to_pylist(), table, len(kinds)):
                own = ids_of(codes)
                for row, near in neighbourhood(codes, kinds):
                    slot = near & (bits - 1)
                    keep = (near > own[row]) & ((bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1)
                    yield pa.RecordBatch.from_arrays([pa.array(own[row[keep]]), pa.array(near[keep])], ["a", "b"])

    return mapped(spread(single).select("word"), run, "a long, b long")


def level(words: DataFrame, symbols: int | None, bucket: int) -> tuple[DataFrame, DataFrame]:
    """(pairs of words at this level, words for the next)."""
    words = stored(keyed(words, symbols), "spelling-words")
    sizes = words.groupBy("id").agg(F.count(F.lit(1)).alias("size"))
    lists = words.join(sizes.where(F.col("size") <= bucket), "id").groupBy("id").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    lists = stored(sizes.join(lists, "id", "left").select("id", "words"), "spelling-lists")
    a, b = (lists.select(F.col("id").alias(s), F.col("words").alias(f"words_{s}")) for s in "ab")
    met = reduced_pairs(words, symbols).join(b, "b").join(a, "a").union(a.join(b, F.col("a") == F.col("b")).select("a", "b", "words_b", "words_a"))
    met = stored(met, "spelling-met")
    cold = met.where("words_a IS NOT NULL AND words_b IS NOT NULL")
    pairs = cold.select("a", "b", F.explode("words_a").alias("x"), "words_b").select("a", "b", "x", F.explode("words_b").alias("y"))
    pairs = pairs.where(((F.col("a") < F.col("b")) | (F.col("x.word") < F.col("y.word"))) & (F.levenshtein("x.word", "y.word", 1) == 1))
    hot = met.where("words_a IS NULL OR words_b IS NULL").select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return pairs.select("x", "y"), words.join(hot, "id", "left_semi").select("word", "n")


def near_words(words: DataFrame, symbols=SYMBOLS, bucket: int = BUCKET) -> DataFrame:
    """(word, other, other_n): both directions of every pair one edit apart, each once. ``words``: word, n."""
    found, left = [], words
    for k in symbols:
        pairs, left = level(left, k, bucket)
        found.append(stored(pairs, "spelling-pairs"))
        left = stored(left, "spelling-left")
        if left.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    both = every.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p"))
    both = both.select(F.col("p.x.word").alias("word"), F.col("p.y.word").alias("other"), F.col("p.y.n").alias("other_n"))
    return both.distinct() if len(found) > 1 else both


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last, doubling the way each round; each form is ten times as frequent, so rounds are few."""
    out = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = stored(out.join(on, "root", "left").select("word", "root", "next"), "spelling-roots")
        if far.where("next IS NOT NULL").isEmpty():
            return far.select("word", "root")
        out = far.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(docs: DataFrame, symbols=SYMBOLS, bucket: int = BUCKET, ratio: int = RATIO) -> DataFrame:
    """One row per word: form (its most frequent near word, if frequent enough), root, n, n_near, form_n."""
    words = stored(vocabulary(docs), "spelling-vocabulary")
    near = near_words(words, symbols, bucket).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    follows = -F.col("best.less") >= F.col("n") * ratio
    out = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(follows, F.col("best.other")).alias("form"),
        F.when(follows, -F.col("best.less")).alias("form_n")), "spelling-forms")
    named = out.join(roots(out.where("form IS NOT NULL")), "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
