import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from seqspark.llm.packing import WordTokenizer, pack, pieces

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_cover_and_waste_little():
    for total in [1, 2, 63, 1000, 3000, 4095, 4096, 4097, 9999]:
        cut = pieces(total, 4096, 0.02)
        assert sum(cut) == total
        assert all(4096 - (4096 // n) * n <= 0.02 * 4096 for n in cut)


def test_round_trip_against_tokenizer(spark):
    texts = ["The cat's é\tèa  \n\n12 dogs", None, "", "a" * 9000 + " bc, de. " * 3000, "<|endoftext|> x <|ENDOFTEXT|>", "\x1c á  b", "dup", "dup"]
    rows = [(i if i < 7 else 6, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id long").repartition(2)
    got = pack(docs, PATH).toPandas()
    tok = Tokenizer.from_file(PATH)
    for doc_id, t, k in rows[:6]:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        mine = got[got.doc_id == doc_id].sort_values("start")
        assert mine.length.sum() == len(ids) == mine.doc_tokens.iloc[0]
        for r in mine.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert len(got[(got.doc_id == 6) & (got.start == 0)]) == 2
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.iloc[0] == 0 and (g.offset.values[1:] == (g.offset + g.length).values[:-1]).all()
        assert g.length.sum() <= 4096


def test_ids_equal_those_of_the_whole_text():
    rng = random.Random(3)
    parts = list("aBcÉßµªºİIıΣσς ǅﬁ̈ñ\n\t ..,!?:;'sStTdD<|>-_²½٣५中あ한🙂\u200d\xad\xa0\x85\x1f$&#")
    parts += ["<|endoftext|>", "<|ENDOFTEXT|>", "'ll", "'re", "İ.", "ΑΣ.", "word&&&", " "]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(5000)]
    for path in (PATH, public_tokenizers.path("byte_bpe_50k.json")):  # by words; whole texts
        own, tok = WordTokenizer(path), Tokenizer.from_file(path)
        assert own.by_word == (path == PATH)
        for at in (0, 2500):
            ids, edge = own.encode(texts[at : at + 2500])
            for k, t in enumerate(texts[at : at + 2500]):
                assert ids[edge[k] : edge[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
