import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tenderweave.llm import tokens
from tenderweave.llm.tokens import WordEncoder, file_bytes, open_file, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_give_the_ids_of_whole_texts():
    whole, words = Tokenizer.from_file(PATH), WordEncoder(PATH, "<u4")
    rng = random.Random(4)
    alphabet = ["a", "B", "é", "É", "ß", "İ", "H̱", "ÿ", "Þ", "×", "÷", "À", "ŀ", "\u00a0", "|", "<", "`", " ", "\n", "\t", " ", "\u0085", "\x1c", "1", "23", "'s", "'", "’", ",", "%%%", "<|endoftext|>", "<|", "|>", "the", "Über", "日本", "́", "🙂", "‍", "\x00"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 12))) for _ in range(3000)]
    for k in range(0, len(texts), 100):
        for text, ids in zip(texts[k : k + 100], words.encode(texts[k : k + 100])):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_files_hold_equal_sequences_with_masks():
    parts = [np.arange(k, dtype="<u2").tobytes() for k in (3, 1, 0, 20)]
    content = file_bytes([5, 6, 7, 8], parts, 7, "<u2", rows=2)
    ids, table, index = open_file(content)
    assert ids.tolist() == [*range(3), 0, *range(20)]
    assert table.schema.field("ids").type == pa.list_(pa.uint16(), 7) and table.num_rows == 4
    assert sum(map(sum, table.column("mask").to_pylist())) == 24
    assert index.tolist() == [(5, 0, 3), (6, 0, 1), (7, 0, 0), (8, 0, 20)]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokens, "FILE_BYTES", 300)
    rng = random.Random(6)
    docs = [(d * 37 % 211, " ".join(rng.choice(["Idea", "thnt,", "é!", "a1"]) for _ in range(rng.randrange(0, 90)))) for d in range(200)]
    docs += [(300, None), (301, ""), (5, "again"), (5, "again"), (302, "long " * 9000), (None, "nobody's"), (None, None), (None, "again")]
    whole = Tokenizer.from_file(PATH)
    expected, start = [], 0
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, start string").repartition(5)
    monkeypatch.setattr(tokens, "PARTS", 2)  # the files' starts are summed up over runs of partitions
    assert sorted((tuple(r) for r in token_files(df, PATH).collect()), key=str) == sorted(expected, key=str)
    assert token_files(df.limit(0), PATH).collect() == []


def test_other_tokenizers_get_whole_texts(tmp_path):
    import json

    rules = json.load(open(PATH))
    rules["normalizer"]["normalizers"].pop()  # keeps capitals
    other = tmp_path / "cased.json"
    other.write_text(json.dumps(rules))
    assert tokens.joins_no_words(Tokenizer.from_file(PATH)) and not tokens.joins_no_words(Tokenizer.from_file(str(other)))
    text = "The Cat SAT, on 12 Mats"
    assert np.frombuffer(WordEncoder(str(other), "<u4").encode([text, None])[0], "<u4").tolist() == Tokenizer.from_file(str(other)).encode(text, add_special_tokens=False).ids


def test_parts_are_learnt_once_however_they_are_written():
    whole, words = Tokenizer.from_file(PATH), WordEncoder(PATH, "<u2")
    texts = ["Idea, IDEA; idea (iDeA)", None, "a1-b2 b22\tÉté\n été,", "DON'T don't <|endoftext|>", "", "été"]
    seen = []
    learn = words._learn
    words._learn = lambda new: (seen.extend(new), learn(new))[1]
    for _ in range(2):
        assert [np.frombuffer(i, "<u2").tolist() for i in words.encode(texts)] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sorted(seen) == sorted([b"idea", b",", b";", b"(", b")", b"a", b"1", b"-", b"b", b"2", "été".encode(), b"DON'T", b"don't", b"<|endoftext|>"])


def test_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PARTS", 5)
    whole, words = Tokenizer.from_file(PATH), WordEncoder(PATH, "<u4")
    for k in range(40):
        text = f"the word{chr(97 + k % 26)} and 日本{k} of {k}"
        assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(words.parts) < 15


def test_slices_hold_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(tokens, "TEXT_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n if n != 3 else None for n in (0, 4, 3, 5, 30, 0, 10, 1, 9, 9, 0)]})
    cut = list(tokens._slices(batch))
    assert pa.Table.from_batches(cut).to_pydict() == batch.to_pydict()
    assert [len(c) for c in cut] == [5, 2, 2, 2]
