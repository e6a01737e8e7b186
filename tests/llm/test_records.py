from __future__ import annotations

import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from comparing import TESTDATA
from tokenizers import Tokenizer

from concord.llm import records
from concord.llm.wordids import LedWords, SpacedWords, WordIds

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_tokenizer(path=PATH):
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def expected(rows):
    """(doc_id, start, n_tokens, ids_crc32) of rows in order, one text at a time."""
    encode, start = plain_tokenizer().encode, 0
    for doc_id, text in rows:
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        yield doc_id, start, len(ids), zlib.crc32(ids.tobytes())
        start += len(ids)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[1])


def test_query_equals_one_text_after_the_other(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert rows_of(records.round_trip(docs)) == list(expected(rows))


def test_awkward_rows_and_empty_table(spark):
    found = rows_of(records.round_trip(brute.awkward(spark)))
    alone = {(i, t): (n, c) for (i, t), (_, _, n, c) in zip(brute.AWKWARD, expected(brute.AWKWARD))}
    assert sorted((r[0] or -1, r[2], r[3]) for r in found) == sorted((i or -1, *alone[i, t]) for i, t in brute.AWKWARD)
    assert [r[0] for r in found] == sorted((i for i, _ in brute.AWKWARD), key=lambda i: -1 if i is None else i)
    assert [r[1] for r in found] == [sum(x[2] for x in found[:k]) for k in range(len(found))]
    assert records.round_trip(brute.empty(spark)).collect() == []


def test_shuffled_reads_give_every_record_once(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    files = records.write_records(docs)
    straight = {(r.doc_id, r.start, bytes(r.ids)) for r in records.read_records(files, block_records=7).collect()}
    orders = []
    for seed in (1, 2):
        shuffled = records.read_shuffled(files, seed, tasks=3).collect()
        orders.append([r.doc_id for r in shuffled])
        assert {(r.doc_id, r.start, bytes(r.ids)) for r in shuffled} == straight and len(shuffled) == len(straight)
    assert orders[0] != orders[1] != sorted(orders[1])


def test_damage_is_noticed(spark):
    docs = spark.createDataFrame([(i, "some words here") for i in range(4)], brute.SCHEMA).coalesce(1)
    file = records.write_records(docs).first()["file"]
    with open(file, "r+b") as data:
        data.seek(30)
        byte = data.read(1)[0] ^ 1
        data.seek(30)
        data.write(bytes([byte]))
    files = spark.createDataFrame([(file, 4, len(open(file, "rb").read()), 2)], records.FILES)
    with pytest.raises(Exception, match="does not check out"):
        records.read_records(files).collect()


@pytest.mark.parametrize("where", [5, 10, 14, 22, -2])
def test_frame(where):
    record = records.frame(7, b"\x01\x00\x02\x00")
    assert records.unframe(record, "x") == (7, b"\x01\x00\x02\x00")
    assert records.unframe(records.frame(None, b""), "x") == (None, b"")
    damaged = bytearray(record)
    damaged[where] ^= 4
    with pytest.raises(ValueError):
        records.unframe(bytes(damaged), "x")


@pytest.mark.parametrize(("vocabulary", "rule"), [("byte_bpe_50k.json", LedWords()), ("word_bpe_49k.json", SpacedWords())])
@pytest.mark.parametrize("limit", [0, 50, 10_000])
def test_word_ids_equal_those_of_whole_texts(vocabulary, rule, limit):
    """Every letter and mark below U+20000 before and behind marks and spaces, and texts met again with a full memory."""
    path = public_tokenizers.path(vocabulary)
    encode = plain_tokenizer(path).encode_batch
    points = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    texts = [f"{c}. a{c}, {c}{c}; cam{c}! ({c}) a {c} b\n{c}" for c in points] if limit == 10_000 else []
    texts += [t or "" for _, t in brute.AWKWARD] + ["it's don't. dogs' 'tis I'LL x'd  y\n\n z \t q\r\n", "&&& a*** |b| ", "\n", " "]
    texts += [" ".join(f"word{i}" for i in range(k, k + 90)) for k in range(0, 400, 10)] * 2
    own = WordIds(path, rule, limit)
    for at in range(0, len(texts), 5000):
        some = texts[at : at + 5000]
        for text, found, want in zip(some, own.encode_all(some), encode(some, add_special_tokens=False)):
            assert found.tolist() == want.ids, text
    assert len(own.numbers) <= max(limit, 1)


@pytest.mark.parametrize("rule", [LedWords(), SpacedWords()])
def test_equal_words_are_looked_up_once(rule):
    """A word that fills a text is looked up once for the texts that are encoded together."""
    path = public_tokenizers.path("byte_bpe_50k.json" if isinstance(rule, LedWords) else "word_bpe_49k.json")
    own, asked = WordIds(path, rule), []

    class Asked(type(own.numbers)):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    own.numbers = Asked()
    assert len(own.encode(["one two " * 1000, "\n one\tone two"])) == 2 and len(asked) < 20


def test_names_of_led_words_tell_their_texts_apart():
    rule, texts = LedWords(), [a + b + c for a in ("", " ", "\n", "\t") for b in ("", " ", "\n") for c in ("", "\n", " x", "x")]
    names = {text: rule._name(text) for text in texts}
    assert len(set(names.values())) == len(set(texts)) and all(rule.text(n) == t for t, n in names.items())


def test_writing_and_reading_give_memory_back(spark, monkeypatch):
    """A writer takes few documents at a time; a reader begins by giving back what was freed after writing."""
    trimmed = []
    monkeypatch.setattr(records, "trim", lambda: trimmed.append(1))
    assert list(records._fetch(iter([]))) == [] and trimmed
    rows, name = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    monkeypatch.setattr(records, "written", lambda df: rows.append(spark.conf.get(name)) or df)
    records.write_records(brute.empty(spark))
    assert rows == [str(records.BATCH_ROWS)] and spark.conf.get(name) == before
