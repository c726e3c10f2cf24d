import hashlib

import numpy as np
import public_tokenizers
import sentencepiece

from sagewell.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["Hello  world", "", None, " \t a\n", "日本語 \U0001f600\x00z", "<s> x </s><unk>", "é" * 50_000, "▁▁ a"]


def test_ids_spans_and_decoding_equal_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], [1])],
                                 "doc_id long, text string, ids array<int>")
    rows = pieces.encode(docs, PATH, outputs=("ids", "spans", "decoded", "digests")).collect()
    assert len(rows) == len(TEXTS) + 1
    for row in rows:
        text = TEXTS[row.doc_id] or ""
        ids = model.encode(text, add_bos=True, add_eos=True)
        assert row.ids == ids and row.n_tokens == len(ids) and row.decoded == model.decode(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        data = text.encode()
        # Begin and end are empty; the other spans tile the whole original in order.
        assert row.begins[1:-1] == ([0] + row.ends[1:-2] if len(ids) > 2 else [])
        assert not data or (row.begins[1], row.ends[-1]) == (0, len(data))
        for i, begin, end in zip(ids[1:-1], row.begins[1:-1], row.ends[1:-1], strict=True):
            if not model.is_byte(i):
                shown = model.id_to_piece(i).replace("▁", " ")
                assert data[begin:end].decode().replace("▁", " ") in (shown, shown[1:])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encode(docs, PATH).count() == 0


def test_character_map_takes_the_longest_prefix_and_keeps_the_alignment():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True,
                                                    remove_extra_whitespaces=True, escape_whitespaces=True)
    spec = next(v for n, v in pieces._fields(library.serialized_model_proto()) if n == 3)
    own = pieces.Normaliser(spec)
    for text in ["  ﬁne　 ①②  x ", "ｱﾞ ﷺ", "é", "", "   ", "plain"]:
        data, align = own(text.encode())
        assert data.decode() == library.normalize(text)
        assert len(align) == len(data) + 1 and (np.diff(align) >= 0).all()
    data, align = own("ﬁne".encode())
    assert data == "▁fine".encode() and align.tolist() == [0, 0, 0, 0, 0, 3, 4, 5]


def test_query_and_stage_find_the_spans_of_every_document(spark):
    import corpus_pipeline

    import __spark_entry__ as entry
    from sagewell.sources.tables import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    found = pieces.encode(docs, PATH, outputs=("ids", "spans")).collect()
    expected = {}
    for row in found:
        pairs = np.array([row.begins, row.ends], dtype="<u8").T
        assert pairs[0].tolist() == [0, 0] and pairs[-1, 0] == pairs[-1, 1]
        expected[row.doc_id] = len(row.ids), hashlib.sha256(pairs.tobytes()).hexdigest()
    assert len(expected) == len(found) == docs.count()
    stage = dict(corpus_pipeline.STAGES)["pieces"](spark, docs, "/root/testdata/sf0.001")
    for rows in (entry.queries()["op2_sentencepiece"](spark, "/root/testdata/sf0.001"), stage):
        assert {r.doc_id: (r.n_tokens, r.spans_sha256) for r in rows.collect()} == expected
