"""Collocations by dynamic itemset counting.

The corpus lies in ``shards`` parts that are scanned one after the other, again and again. Words are counted from the first
part on. A longer phrase is counted from the part on before which both of its subphrases (all but the last word, all but
the first) had reached the threshold, and stops after as many parts, when each has been seen once. So lengths are
interleaved: phrases of frequent words start while rarer words are still being counted. The scan ends when every phrase
that started has completed its cycle. No phrase that reaches the threshold is missing, because its subphrases occur at
least as often.

Most phrases that start stay below the threshold. Therefore phrases of several words are counted by hash first, and those that
reach the threshold are counted once more, as texts, over the cycle that follows, which is the cycle in which longer phrases
grow from them; words are counted as texts at once. Hashes travel and stay in blocks: sorted, as differences in as few bytes
as they need, a row for each range of hashes. Two phrases of one hash can only make each other start early, so that the counts
of texts are exact.

When a phrase reached the threshold has to be known where texts are read. Each length keeps one byte per slot of a fixed
table: the part before which a phrase of that slot reached it. Phrases that share a slot may start early, which costs work
but no exactness, because each is counted over a whole cycle from its own start.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import LOWER, remove, shared_path, shuffle_partitions, shuffles_removed, written, written_at
from concord.llm.kneser_ney import narrow, run_heads, widened

#: Where a phrase cannot go on: ``[.,;:!?\x0A-\x0D]``. The byte 0xFF is in no UTF-8 text.
_BREAK = b".,;:!?\x0a\x0b\x0c\x0d"
_TRANSLATE = bytes(0xFF if c in _BREAK else LOWER[c] for c in range(256))
_BREAK_WORD = b"\xff"
NEVER = 255
#: Words counted together in a task: bounds its memory.
WORDS_AT_ONCE = 1 << 21
ROWS_AT_ONCE = 1 << 16
#: A row is a phrase as text with its count, or a block of ``f`` hashes from ``first`` on.
COUNTED = "lang string, words int, phrase string, f long, bin int, first long, gaps binary, counts binary"
MERGED = "f long, bin int, first long, gaps binary, counts binary, frequent array<long>"
#: Bits of a hash that are kept; text in bytes for each range of hashes.
HASH_BITS, BIN_BYTES = 40, 16 << 20
#: Strands in which each language's best are picked before they meet.
STRANDS = 16


def _slots(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes & np.uint64(slots - 1)).astype(np.int64)


def joined_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hashes of its first words and of its last word: rotated by 21 and added bit by bit."""
    return ((left << np.uint64(21)) | (left >> np.uint64(43))) ^ right


class _Words(dict):
    """Numbers the words of one language in a stretch of texts."""

    def __init__(self, lang: str, names: list[tuple[str, bytes]]) -> None:
        super().__init__({_BREAK_WORD: 0})
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.names)
        self.names.append((self.lang, word))
        return number


class _Stretch:
    """Texts that are counted together: a stream of word numbers, 0 where a piece ends."""

    def __init__(self) -> None:
        self.names: list[tuple[str, bytes]] = [("", b"")]
        self.of_lang: dict[str, _Words] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        if lang not in self.of_lang:
            self.of_lang[lang] = _Words(lang, self.names)
        self.parts.append(np.fromiter(map(self.of_lang[lang].__getitem__, words), dtype=np.int64, count=len(words)))
        self.size += len(words)

    def hashes(self) -> np.ndarray:
        seeds = {lang: xxhash.xxh64_intdigest(lang.encode(), 42) for lang in self.of_lang}
        return np.array([xxhash.xxh64_intdigest(w, seeds.get(lang, 0)) for lang, w in self.names], dtype=np.uint64)


def distinct(stream: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and counts of the distinct phrases of ``n`` words that begin at the places."""
    ids, bits = stream[place], max(1, int(stream.max()).bit_length())
    if n * bits < 64:
        for i in range(1, n):
            ids = (ids << bits) | stream[place + i]
        ids.sort()
        heads, counts = run_heads(ids)
        return (ids[heads][:, None] >> (bits * np.arange(n - 1, -1, -1))) & ((1 << bits) - 1), counts
    for i in range(1, n):
        if i > 1:
            ids = np.unique(ids, return_inverse=True)[1]
        ids = (ids << 32) | stream[place + i]
    _, first, counts = np.unique(ids, return_index=True, return_counts=True)
    return stream[place[first][:, None] + np.arange(n)], counts


def count_stretch(
    stream: np.ndarray, words: np.ndarray, step: int, shards: int, longest: int, since: list[np.ndarray]
) -> Iterator[tuple[int, np.ndarray | None, np.ndarray | None, np.ndarray]]:
    """(length, members, hashes, counts) of the phrases to be counted in this step.

    ``members`` has one row of word numbers for each phrase to be counted as text, ``hashes`` are sorted, of those counted by
    hash. ``words`` are the hashes of the words, ``since[n - 1]`` the step from which on phrases of ``n`` words are frequent, by slot.
    """
    if step < shards:
        found, counts = np.unique(stream[stream > 0], return_counts=True)
        yield 1, found[:, None], None, counts
    # Of the phrase of a length that begins at each place: its hash, and the step from which on longer ones may grow from it.
    hashes = words[stream]
    ready = np.where(stream > 0, since[0][_slots(words, len(since[0]))][stream], np.uint8(NEVER))
    for n in range(2, longest + 1):
        start = np.maximum(ready[:-1], ready[1:])
        place = np.flatnonzero(start <= step)
        if not len(place):
            return
        began = start[place].astype(np.int64)
        own = joined_hash(hashes[place], words[stream[place + n - 1]])
        due = began > step - shards
        if due.any():
            keys = np.sort(own[due] & np.uint64((1 << HASH_BITS) - 1))
            heads, counts = run_heads(keys)
            yield n, None, keys[heads], counts
        # Phrases that completed their cycle are still needed by longer ones.
        text_from = np.maximum(began, since[n - 1][_slots(own, len(since[n - 1]))])
        due = (text_from <= step) & (text_from > step - shards)
        if due.any():
            members, counts = distinct(stream, place[due], n)
            yield n, members, None, counts
        ready = np.full(len(start), NEVER, dtype=np.uint8)
        ready[place] = text_from
        hashes = np.zeros(len(start), dtype=np.uint64)
        hashes[place] = own


def blocks_of(keys: np.ndarray, counts: np.ndarray, bins: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(rows, bin, first, gaps, counts) of sorted distinct hashes, for each range of hashes that has some."""
    if not len(keys):
        return
    to = ((keys * np.uint64(bins)) >> np.uint64(HASH_BITS)).astype(np.int64)
    heads, _ = run_heads(to)
    for at, some, times in zip(heads, np.split(keys, heads[1:]), np.split(counts, heads[1:])):
        yield len(some), int(to[at]), int(some[0]), narrow(np.diff(some)), narrow(times)


def keys_of(rows: int, first: int, gaps: bytes) -> np.ndarray:
    """The hashes of a block."""
    return np.cumsum(np.concatenate((np.array([first], dtype=np.uint64), widened(gaps, rows - 1))), dtype=np.uint64)


def _merge(threshold: int, bins: int) -> Callable[[pa.Table], pa.Table]:
    """Blocks of one range of hashes as one block, and which of its hashes reached the threshold."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys = np.concatenate([keys_of(r["f"], r["first"], r["gaps"]) for r in rows])
        counts = np.concatenate([widened(r["counts"], r["f"]) for r in rows])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        heads, _ = run_heads(keys)
        keys, counts = keys[heads], np.add.reduceat(counts[order], heads)
        block = next(blocks_of(keys, counts, bins))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        columns = [pa.array([x], kind) for x, kind in zip((*block, keys[counts >= threshold].tolist()), kinds)]
        return pa.Table.from_arrays(columns, names=["f", "bin", "first", "gaps", "counts", "frequent"])

    return run


def _count_step(shard: DataFrame, step: int, shards: int, longest: int, since: list, bins: int) -> DataFrame:
    """Counts of one scan, combined within each stretch of a task: texts, or blocks of hashes where phrase is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.frombuffer(zlib.decompress(table.value), dtype=np.uint8) for table in since]
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        columns = ["lang", "words", "phrase", "f", "bin", "first", "gaps", "counts"]

        def batch_of(n: int, rows: int, **given: pa.Array) -> pa.RecordBatch:
            given["words"] = pa.array(np.full(rows, n), pa.int32())
            parts = [given.get(c, pa.nulls(rows, k)) for c, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays(parts, names=columns)

        def counted(stretch: _Stretch) -> Iterator[pa.RecordBatch]:
            langs = pa.array([lang for lang, _ in stretch.names], pa.string())
            names = pa.array([word for _, word in stretch.names], pa.binary())
            for n, members, hashes, counts in count_stretch(
                np.concatenate(stretch.parts), stretch.hashes(), step, shards, longest, tables
            ):
                if members is None:
                    blocks = list(zip(*blocks_of(hashes, counts, bins)))
                    given = {c: pa.array(v, k) for c, v, k in zip(columns[3:], blocks, kinds[3:])}
                    yield batch_of(n, len(blocks[0]), **given)
                    continue
                for at in range(0, len(counts), ROWS_AT_ONCE):
                    f = counts[at : at + ROWS_AT_ONCE]
                    rows = [pa.array(c) for c in np.ascontiguousarray(members[at : at + ROWS_AT_ONCE].T)]
                    lang, words = langs.take(rows[0]), [names.take(c) for c in rows]
                    phrase = pc.binary_join_element_wise(*words, pa.scalar(b" ")) if n > 1 else words[0]
                    yield batch_of(n, len(f), lang=lang, phrase=phrase.cast(pa.string()), f=pa.array(f, pa.int64()))

        stretch = _Stretch()
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                words = text.as_py().translate(_TRANSLATE).replace(b"\xff", b" \xff ").split()
                words.append(_BREAK_WORD)
                stretch.add(lang.as_py(), words)
                if stretch.size >= WORDS_AT_ONCE:
                    yield from counted(stretch)
                    stretch = _Stretch()
        if stretch.size:
            yield from counted(stretch)

    return shard.mapInArrow(run, COUNTED)


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("f").alias("f"))


def _slots_of(frequent: DataFrame, slots: int) -> np.ndarray:
    """The slots that hold one of the phrases with hash ``h``, as booleans.

    64 slots are one number, so that at most ``slots / 64`` rows come to the driver, whatever the corpus.
    """
    slot = F.col("h").bitwiseAND(F.lit(slots - 1))
    found = (
        frequent.select(slot.alias("slot"))
        .selectExpr("shiftright(slot, 6) AS at", "shiftleft(1L, CAST(slot & 63 AS INT)) AS bit")
        .groupBy("at")
        .agg(F.bit_or("bit").alias("bits"))
    )
    mask = np.zeros(slots // 64, dtype=np.int64)
    for part in found.toArrow().to_batches():
        at, bits = (column.to_numpy(zero_copy_only=False) for column in part.columns)
        mask[at] = bits
    return np.unpackbits(mask.view(np.uint8), bitorder="little").astype(bool)


def phrase_counts(
    docs: DataFrame,
    threshold: int = 10,
    longest: int = 3,
    shards: int = 4,
    slots: int = 1 << 23,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """(lang, words, phrase, f): all words, and exact counts of all phrases that occur at least ``threshold`` times.

    ``slots`` is the size of the table of each length in bytes, a power of two, held by the driver and every worker. Words are
    looked at after every part, longer phrases after every round of parts.
    """
    spark = docs.sparkSession
    if shards * (longest + 1) >= NEVER or slots & (slots - 1) or slots < 64 or longest < 1:
        raise ValueError("at most 254 steps, slots a power of two of at least 64, and phrases of at least one word")
    folder = shared_path(spark)
    plain = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
        F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"),
    )
    plain.write.partitionBy("shard").parquet(folder)
    parts = spark.read.schema(plain.schema).parquet(folder)
    size = parts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    bins = max(shuffle_partitions(spark), ceil(size / BIN_BYTES))
    since = [np.full(slots, NEVER, dtype=np.uint8) for _ in range(longest)]
    state: dict[int, tuple[DataFrame, str]] = {}
    scans: list[tuple[DataFrame, str]] = []
    #: The tables as the tasks get them, until they change: a broadcast lies on the disks of the driver and of every executor.
    sent: list[Broadcast | None] = [None] * longest
    step, latest, looked = 0, 0, 0

    def look(n: int, new: list[DataFrame]) -> bool:
        """Adds what was counted of length ``n`` to its state, and marks what reached the threshold."""
        kept = ("lang", "phrase", "f") if n == 1 else ("f", "bin", "first", "gaps", "counts")
        rows = reduce(DataFrame.unionByName, [x.where(F.col("words") == n).where(f"{kept[1]} IS NOT NULL").select(*kept) for x in new])
        before = state.get(n)
        rows = rows.unionByName(before[0].select(*kept)) if before else rows
        with shuffles_removed(spark):
            if n == 1:
                state[n] = written_at(_summed(rows, "lang", "phrase"))
            else:
                state[n] = written_at(rows.groupBy("bin").applyInArrow(_merge(threshold, bins), MERGED))
        if before:
            remove(spark, before[1])
        if n == 1:
            frequent = state[n][0].where(F.col("f") >= threshold).select(F.xxhash64("lang", "phrase").alias("h"))
        else:
            frequent = state[n][0].select(F.explode("frequent").alias("h"))
        fresh = _slots_of(frequent, slots) & (since[n - 1] == NEVER)
        since[n - 1][fresh] = step
        if fresh.any() and sent[n - 1]:
            sent[n - 1].destroy()
            sent[n - 1] = None
        return bool(fresh.any())

    while step < max(shards, latest + shards):
        for i, table in enumerate(since):
            sent[i] = sent[i] or spark.sparkContext.broadcast(zlib.compress(table.tobytes(), 1))
        shard = parts.where(F.col("shard") == step % shards).drop("shard")
        scans.append(written_at(_count_step(shard, step, shards, longest, list(sent), bins)))
        step += 1
        changed = step <= shards and look(1, [scans[-1][0]]) and longest > 1
        if step % shards == 0 or step >= max(shards, latest + shards):
            for n in range(2, longest + 1):
                changed |= look(n, [found for found, _ in scans[looked:]])
            looked = step
        if changed:
            latest = step
    for table in filter(None, sent):
        table.destroy()
    texts = reduce(DataFrame.unionByName, [found for found, _ in scans]).where("phrase IS NOT NULL AND words > 1")
    longer = _summed(texts, "lang", "words", "phrase").where(F.col("f") >= threshold)
    with shuffles_removed(spark):
        counts = written(state[1][0].select("lang", F.lit(1).alias("words"), "phrase", "f").unionByName(longer))
    remove(spark, folder, *[path for _, path in (*scans, *state.values())])
    return counts


def scored(counts: DataFrame) -> DataFrame:
    """Candidates (lang, words, phrase, a, l, r, score) with their weakest cut; score is floor(10^6 a a / (l r))."""
    phrases = counts.where("words >= 2").withColumnRenamed("f", "a")
    cuts = phrases.selectExpr("*", "explode(sequence(1, words - 1)) AS k").selectExpr(
        "*", "substring_index(phrase, ' ', k) AS head", "substring_index(phrase, ' ', k - words) AS tail"
    )
    heads = counts.selectExpr("lang", "phrase AS head", "f AS l")
    tails = counts.selectExpr("lang", "phrase AS tail", "f AS r")
    known = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    product = "CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) * CAST(1000000 AS DECIMAL(7,0))"
    exact = known.selectExpr(
        "lang", "words", "phrase", "a", "k", "l", "r",
        f"({product}) div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0))) AS score",
    )
    weakest = exact.groupBy("lang", "words", "phrase", "a").agg(F.expr("min(struct(score, k, l, r)) AS cut"))
    return weakest.select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def outside_longer(candidates: DataFrame, longest: int, percent: int = 50) -> DataFrame:
    """Candidates but those inside a longer candidate that occurs at least ``percent`` of their times."""
    spans = ", ".join(
        f"struct({n} AS n, {at} AS at)" for n in range(2, longest) for at in range(1, longest - n + 2)
    )
    if not spans:
        return candidates
    parts = candidates.where("words > 2").selectExpr("lang", "words", "a", "split(phrase, ' ') AS w", f"inline(array({spans}))")
    covering = (
        parts.where("n < words AND at + n - 1 <= words")
        .selectExpr("lang", "array_join(slice(w, at, n), ' ') AS phrase", "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("__longer"))
    )
    joined = candidates.join(covering, ["lang", "phrase"], "left")
    return joined.where(f"__longer IS NULL OR 100 * __longer < {percent} * a").drop("__longer")


def best_of(candidates: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` candidates of each language, with their rank; picked in strands first."""
    order = "score DESC, a DESC, phrase"
    strand = f"pmod(xxhash64(phrase), {STRANDS})"
    picked = candidates.selectExpr("*", f"row_number() OVER (PARTITION BY lang, {strand} ORDER BY {order}) AS __at")
    picked = picked.where(F.col("__at") <= limit).drop("__at")
    ranked = picked.selectExpr("*", f"row_number() OVER (PARTITION BY lang ORDER BY {order}) AS rank")
    return ranked.where(F.col("rank") <= limit)


def collocations(
    docs: DataFrame,
    threshold: int = 10,
    longest: int = 3,
    limit: int = 2000,
    percent: int = 50,
    shards: int = 4,
    slots: int = 1 << 23,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut into pieces at ``[.,;:!?\\x0A-\\x0D]``, pieces into words at spaces and tabs. A phrase
    of 2 to ``longest`` words counts with all its occurrences inside pieces; its score is that of its weakest cut. A null
    language is ``und``, null and empty texts hold no word, whole texts count whatever their length, repeated rows count each
    time, equal scores rank by count and then by the phrase's bytes, other columns are not looked at, and an empty table
    gives no rows.
    """
    counts = phrase_counts(docs, threshold, longest, shards, slots, lang_col, text_col)
    totals = counts.where("words = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    found = best_of(outside_longer(written(scored(counts)), longest, percent), limit)
    # As many totals as languages, which has no bound, so the join is left to its measured size.
    return found.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )
