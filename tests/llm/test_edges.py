"""Unknown characters in unigram models, constants passed on in bulk, special tokens, and clashing names."""

import random
import struct
import time

import pyarrow as pa
import pytest

import corpus_pipeline
from weftline.llm import byte_bpe, chat_format, secrets, sentencepiece_codec


def _message(field, body):
    return bytes([field << 3 | 2, len(body)]) + body


def _unigram(pieces):
    kinds = [("<unk>", 0.0, 2), *[(p, s, 1) for p, s in pieces]]
    rows = [_message(1, _message(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + bytes([3 << 3, k])) for p, s, k in kinds]
    return b"".join(rows) + _message(2, bytes([3 << 3, 1])) + _message(3, bytes([3 << 3, 0, 4 << 3, 0]))


def test_unigram_search_weighs_unknown_characters_against_pieces():
    model = sentencepiece_codec.Model(_unigram([("ab", -1.0), ("bc", -100.0)]))
    assert [model.pieces[i] for i in model.encode("abc")] == ["ab", "<unk>"]
    rng = random.Random(2)
    for _ in range(150):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 3))): -float(rng.randint(1, 60)) for _ in range(6)}
        model = sentencepiece_codec.Model(_unigram(sorted(pieces.items())))
        text = "".join(rng.choice("abcx") for _ in range(rng.randint(1, 60)))
        cost = min(pieces.values()) - sentencepiece_codec.UNKNOWN_PENALTY
        best = [0.0]
        for i in range(1, len(text) + 1):
            best.append(max([best[i - 1] + cost, *[best[j] + pieces[text[j:i]] for j in range(max(0, i - 3), i) if text[j:i] in pieces]]))
        # ids have a run of unknown characters once: what is left over is unknown
        ids = model.encode(text)
        known = [model.pieces[i] for i in ids if i != model.unknown]
        score = sum(pieces[p] for p in known) + cost * (len(text) - sum(map(len, known)))
        assert score == best[-1], (pieces, text)


def test_special_tokens_are_as_the_library_has_them():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(byte_bpe.default_path())
    rng = random.Random(8)
    parts = ["<|endoftext|>", " ", "x", "\n", "<|endoftext|", "é", "  ", "don't", "|>"]
    texts = ["x<|endoftext|>y", *["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(300)]]
    ids, before = byte_bpe.batch_ids(pa.array(texts), byte_bpe.read(byte_bpe.default_path()))
    for k, text in enumerate(texts):
        assert ids[before[k] : before[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


def test_constants_passed_on_in_bulk_take_time_in_proportion():
    n = 25_000
    text = "\n".join(['x = "Zx9qPl2vv8Rt1aB3k"'] * n + [f"y_{i} = x" for i in range(n)] + ["password = y_3"])
    began = time.process_time()
    found = secrets.spans(text)
    assert len([s for s in found if s[0] == "literal"]) == n and time.process_time() - began < 10


@pytest.mark.parametrize(
    ("text", "literal"),
    [
        ('password = "Ab39" + "dkEl3kd9fKq2"', 'Ab39" + "dkEl3kd9fKq2'),
        ('token = """\nAbc39xkEl3kd9fKq2\n"""', "Abc39xkEl3kd9fKq2"),
        ("salt = '''Abc39xkEl3kd9fKq2'''", "Abc39xkEl3kd9fKq2"),
        ('a = "Zx9qPl2vv8Rt1aB3k"\nb = a\nc = b\nb = c\nsecret_key = c', "Zx9qPl2vv8Rt1aB3k"),
    ],
)
def test_lexer_reads(text, literal):
    assert literal in [text[a:b] for k, a, b in secrets.spans(text) if k == "literal"]


def test_lexer_reads_very_long_strings_without_an_end():
    for text in ('password = """' + "a" * 300_000, 'token = "' + "b" * 300_000, 'x = """ a\n' * 10_000, 'key = "a" + ' * 20_000):
        secrets.spans(text)


def test_chats_ignore_columns_that_differ_by_capitals(spark):
    rows = [("c1", 1, "user", "hi", "x", 5), ("c1", 2, "bot", "yo", "x", 5), ("c2", 1, "user", "hi", "x", 5)]
    got = chat_format.format_chats(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, CONV_ID string, digest int"))
    assert [(r.conv_id, r.n_turns) for r in got.collect()] == [("c1", 2)]


def test_pipeline_stages_stand_clashing_names_repeated_rows_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, DOC_ID string, TEXT int, severity string, component_id int, _spans int"
    text = "one two three four five six password=hunter2hunter2"
    rows = [(1, text, "en", "s", 10, "z", 1, "sev", 2, 3), (1, text, "en", "s", 10, "z", 1, "sev", 2, 3), (2, None, None, None, None, "z", 1, None, None, None), (3, "", "en", "s", 0, "z", 1, "sev", 2, 3)]
    spark.createDataFrame([(1, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    full, empty = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, full, str(tmp_path))
        assert out.columns == full.columns, name
        kept = sorted(map(tuple, out.collect()), key=str)
        assert len(kept) == (3 if name == "near_dedup" else 4), name
        if name == "secrets":
            assert {r[1] for r in kept} == {None, "", "one two three four five six [SECRET]"} and {r[5] for r in kept} == {"z"}
        assert stage(spark, empty, str(tmp_path)).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).collect() == []
