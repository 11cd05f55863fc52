"""Spelling variants: words of one text collection that differ by one code point, and the form each belongs to.

The vocabulary is counted on Spark. Near words are found by dynamic programming over sorted lists. A pair's first
difference lies in the first or in the second half of the shorter word, so the pair agrees before it or behind it: words
are dealt into groups that agree outside of one window, and every pair is looked for in one group alone. Inside a group
the window texts are scanned in sorted order against each of them: rows of the edit matrix, banded to the diagonal and its
neighbours, are kept for the prefix shared with the word before and computed anew only behind it, and all words below a
prefix whose row exceeds one edit are skipped. A group over ``GROUP`` words has its window halved, again and again; a
window of one code point holds at most as many words as there are letters, so that no group stays large.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroll.llm.common import grouped, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "a-zÀ-ÿ"
SHORTEST, LEAST, RATIO, SLIP = 6, 5, 5, 199
#: Words of a group that one task scans, and entries of many groups about.
GROUP, TASK_ENTRIES = 4096, 50_000
FAR = 2


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, slip: int | None = SLIP) -> DataFrame:
    """word, n: the letter runs of all texts, A-Z in lower case, of at least ``shortest`` code points that occur ``least`` times.

    With ``slip``, a run loses one letter in the documents where its checksum with the doc_id is divisible by it.
    """
    lower = F.translate("text", UPPER, LOWER)
    # Shorter runs can't become words; a run that is matched is a maximal one, since the match takes all it can.
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"),
        F.explode(F.regexp_extract_all(lower, F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("w"))
    if slip is not None:
        cut = F.expr("cast(h % char_length(w) as int)")
        shorter = F.concat(F.substring("w", F.lit(1), cut), F.substring("w", cut + 2, F.char_length("w")))
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "d", "w").cast("binary"))).select(
            F.when(F.col("h") % slip == 0, shorter).otherwise(F.col("w")).alias("w")).filter(F.char_length("w") >= shortest)
    return runs.groupBy(F.col("w").alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _entries(words: DataFrame) -> DataFrame:
    """Each word once for each window it may differ in, as the shorter or an equally long word and as the longer one.

    ``m`` is the shorter word's length; before ``lo`` and from ``hi`` on (counted in the shorter word) the pair agrees.
    """
    size = F.char_length("word")
    roles = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m"))
    half = F.expr("m div 2")
    zero = F.lit(0)
    return roles.select("word", "n", "m", F.explode(F.array(
        F.struct(zero.alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), F.col("m").cast("long").alias("hi")))).alias("s")).select(
        "word", "n", "m", F.col("s.lo").cast("int").alias("lo"), F.col("s.hi").cast("int").alias("hi"))


def _keyed(entries: DataFrame) -> DataFrame:
    """The group of an entry as text (words hold letters only), and the text in its window."""
    return entries.select(
        "*", F.expr("concat_ws(':', m, lo, hi, left(word, lo), right(word, m - hi))").alias("key"),
        F.expr("substring(word, lo + 1, char_length(word) - lo - (m - hi))").alias("middle"))


def _halved(entries: DataFrame) -> DataFrame:
    """Windows of more than one code point in two halves."""
    mid = F.expr("cast((lo + hi) div 2 as int)")
    return entries.select("word", "n", "m", F.explode(F.array(
        F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))).alias("s")).select(
        "word", "n", "m", "s.lo", "s.hi")


def shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def near_in_list(words: list[str], width: int, open_end: bool) -> Iterator[tuple[int, int]]:
    """(i, j), i < j, of all words of the sorted list at one edit, by banded rows kept for shared prefixes.

    Words have ``width`` code points or one more; two of the longer ones aren't paired here. Without ``open_end``, pairs whose
    first difference lies behind the window don't count.
    """
    lcp = [0] + [shared_prefix(words[k - 1], words[k]) for k in range(1, len(words))]
    for i, q in enumerate(words[:-1]):
        size = len(q)
        # rows[d]: distances of the list word's first d letters to the query's first d - 1, d and d + 1.
        rows = [(FAR, 0, 1 if size else FAR)]
        kept, same, j = 0, size, i + 1
        while j < len(words):
            w = words[j]
            kept = min(kept, lcp[j]) if j > i + 1 else 0
            same = min(same, lcp[j])
            del rows[kept + 1 :]
            d, dead = kept, False
            before, at, after = rows[d]
            while d < len(w):
                x = w[d]
                d += 1
                low = min(before + (d < 2 or d - 2 >= size or x != q[d - 2]), at + 1)
                mid = min(at + (x != q[d - 1]), after + 1, low + 1) if d <= size else FAR
                high = min(after + (x != q[d]), mid + 1) if d < size else FAR
                before, at, after = low, mid, high
                rows.append((low, mid, high))
                if low > 1 and mid > 1 and high > 1:
                    dead = True
                    break
            kept = d
            if dead:
                j += 1
                while j < len(words) and lcp[j] >= d:
                    same = min(same, lcp[j])
                    j += 1
                # The next word shares fewer letters than the row that exceeded one edit.
                continue
            longer = len(w) - size
            distance = rows[len(w)][1 - longer] if -1 <= longer <= 1 else FAR
            if distance == 1 and not (size > width and len(w) > width) and (open_end or same < width):
                yield i, j
            j += 1


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: tuple[list, list, list] = ([], [], [])

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "near", "near_n"])
        for column in out:
            column.clear()
        return batch

    for (key,), rows in grouped(batches, 1):
        if len(rows) < 2:
            continue
        m, lo, hi, head, tail = key.split(":")
        for i, j in near_in_list([r[0] for r in rows], int(hi) - int(lo), hi == m):
            a, b = head + rows[i][0] + tail, head + rows[j][0] + tail
            out[0].extend((a, b))
            out[1].extend((b, a))
            out[2].extend((rows[j][1], rows[i][1]))
        if len(out[0]) >= 20000:
            yield flush()
    yield flush()


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """word, near, near_n: every ordered pair of different words of the table (word, n) at one inserted, deleted or replaced code point."""
    parts, entries = [], _entries(words)
    while True:
        keyed = _keyed(entries)
        # Windows of one code point are small by their alphabet; for the others, the keys of the large groups.
        hot = staged(keyed.filter("hi - lo > 1").groupBy("key").count().filter(F.col("count") > group).select("key"), "spelling-large")
        if hot.isEmpty():
            parts.append(keyed)
            break
        parts.append(keyed.join(hot, "key", "left_anti"))
        entries = _halved(keyed.join(hot, "key", "left_semi"))
    columns = ["key", "middle", "n"]
    all_ = parts[0].select(columns)
    for part in parts[1:]:
        all_ = all_.unionByName(part.select(columns))
    # The scan takes time where the shuffled bytes are few, so tasks are sized by entries (four a word).
    tasks = max(1, -(-4 * words.count() // TASK_ENTRIES))
    return all_.repartition(tasks, "key").sortWithinPartitions("key", "middle").mapInArrow(_scan, "word string, near string, near_n long")


def with_forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the table (word, n)."""
    best = pairs.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("best"))
    form_n = -F.col("best.minus")
    taken = form_n >= ratio * F.col("n")
    formed = staged(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.form")).alias("form"),
        F.when(taken, form_n).alias("form_n")), "spelling-forms")
    # A form occurs at least ``ratio`` times as often as its word, so no chain is longer than the logarithm of the largest n,
    # and every round doubles the way looked ahead.
    up = staged(formed.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        next_ = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if up.join(next_, "root", "left_semi").isEmpty():
            break
        up = staged(up.join(next_, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return formed.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, slip: int | None = SLIP, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the collection, by ``near_words`` and ``with_forms``.

    ``docs``: doc_id, text; whole texts. Words are runs of A-Z, a-z and U+00C0 to U+00FF, only A-Z lower-cased, of at least 6
    code points and 5 occurrences. A null text has no words; a null doc_id counts as empty in the checksum; repeated rows
    count each for themselves; words may have any length. The form is the near word of largest n, ties to the smallest in
    code-point order, if it occurs 5 times as often as the word.
    """
    words = staged(vocabulary(docs, slip=slip), "spelling-words")
    return with_forms(words, near_words(words, group))


ORACLE = """
with recursive
    steps as (select i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as v
              from (select unnest(range(256)) as i)),
    crc as (select list(v order by i) as t from steps),
    runs as (select coalesce(cast(doc_id as varchar), '') as d,
               unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as w from documents),
    per_doc as (select d, w, d || ':' || w as s, count(*) as c from runs where length(w) >= 6 group by 1, 2),
    bytes as (select d, w, c, list_transform(range(strlen(s)), lambda i: cast('0x' || substr(hex(s), 2 * i + 1, 2) as bigint)) as b from per_doc),
    checked as (select w, c, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) as h from bytes, crc),
    kept as (select case when h % 199 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as w, c from checked),
    words as (select w as word, cast(sum(c) as bigint) as n from kept where length(w) >= 6 group by 1 having sum(c) >= 5),
    holes as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(length(word))) as i from words)),
    near as (select a.word, b.word as near, b.n as near_n from holes a join holes b on a.rest = b.rest and a.i = b.i and a.word <> b.word
             union select h.word, w.word, w.n from holes h join words w on h.rest = w.word
             union select w.word, h.word, h.n from holes h join words w on h.rest = w.word),
    best as (select word, count(*) as n_near, max(near_n) as top from near group by 1),
    chosen as (select b.word, b.n_near, b.top, min(near) as near from best b join near on near.word = b.word and near_n = top group by 1, 2, 3),
    formed as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when top >= 5 * n then near end as form, case when top >= 5 * n then top end as form_n
               from words w left join chosen c on c.word = w.word),
    up as (select word, word as here, 0 as depth from formed
           union all select u.word, f.form, depth + 1 from up u join formed f on f.word = u.here where f.form is not null),
    roots as (select word, arg_max(here, depth) as root from up group by 1)
select f.word, form, root, n, n_near, form_n from formed f join roots r on r.word = f.word
"""
