"""Data preparation, sources, sinks, embedding and streaming."""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hubgate import embed, sinks
from hubgate.functions import text, vectors
from hubgate.operators import corpus, pairs
from hubgate.sources import bank
from hubgate.sources import corpus as source


def values(df):
    return [x[0] for x in df.collect()]


def one(spark, values_, kind="string"):
    return spark.createDataFrame([(v,) for v in values_], f"x {kind}")


def test_caption_suffix_takes_the_last_one(spark):
    df = one(spark, ["a_cap1", "a_cap_cap2", "a", "_cap", "a\nb_cap3"])
    assert values(df.select(text.strip_caption_suffix(F.col("x"))))[:4] == ["a", "a_cap", "a", ""]


def test_clean_string_and_eligibility(spark):
    assert values(one(spark, ["  a b\t", " ", "", None]).select(text.clean_string(F.col("x")))) == ["a b", None, None, None]
    rows = [("u", "t", "en"), ("u", "t", None), ("u", "t", "fr"), (" ", "t", "en"), (None, "t", "en"), ("u", "", "en"), ("u", "t", "EN")]
    df = spark.createDataFrame(rows, "url string, caption string, language string")
    assert source.eligible_rows(df).count() == 3
    assert source.eligible_rows(df, english_only=False).count() == 4


def test_domains(spark):
    urls = ["http://A.b:80/x", "a.b/c?d", "https://u@h.c?q", "", None, " x.y "]
    assert values(one(spark, urls).select(text.url_domain(F.col("x")))) == ["a.b:80", "a.b", "u@h.c", "", "", "x.y"]


def test_json_lookups(spark):
    cells = ['{"a": 1}', '{"a": "x", "b": 2}', '{"a": null, "b": "2.5"}', "{}", None, "no json"]
    got = values(one(spark, cells).select(text.json_number(F.col("x"), ("a", "b"))))
    assert got[0] == 1 and np.isnan(got[1]) and got[2] == 2.5 and got[3:] == [None] * 3
    objects = ['{"text": " t "}', '{"TEXT": "", "caption_txt": "c"}', '{"width": 3, "title": "z"}', '{"width": 3}', None]
    assert values(one(spark, objects).select(text.caption_of_json(F.col("x")))) == ["t", "c", "z", None, None]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert values(df.select(vectors.l2_normalize(F.col("v")))) == [[0.6, 0.8], [0.0, 0.0]]
    assert values(df.select(vectors.hamming(F.lit(5), F.lit(6)))) == [2, 2]


def test_splits_and_samples_do_not_depend_on_partitioning(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    a = sorted(map(tuple, corpus.assign_split(df.repartition(7), "k").collect()))
    assert a == sorted(map(tuple, corpus.assign_split(df.coalesce(1), "k").collect()))
    share = sum(s == "train" for _, s in a) / 2000
    assert 0.68 < share < 0.76
    assert sorted(values(corpus.sample_exactly(df.repartition(5), "k", 30))) == sorted(values(corpus.sample_exactly(df, "k", 30)))
    assert sorted({x.shard for x in corpus.shards(df, "k", 3, 2000).collect()}) == [0, 1, 2]


def test_dedupe_keeps_the_best_split_then_the_smallest_key(spark):
    rows = [(1, "a", "test"), (2, "a", "train"), (3, "a", "train"), (4, "b", "val"), (5, "a", "val")]
    df = spark.createDataFrame(rows, "k long, t string, split string")
    assert sorted(values(corpus.drop_duplicates_by_content(df, "t", "k").select("k"))) == [2, 4]
    g = corpus.duplicate_groups(df, "t", "k").first()
    assert (g.n, g.n_splits, g.kept, g.removed) == (4, 3, 2, 3)


def test_domain_distance(spark):
    a, b = one(spark, ["x", "x", "y", ""]).toDF("value"), one(spark, ["x", "z"]).toDF("value")
    assert corpus.share_distance(a, b).first()[0] == pytest.approx((abs(2 / 3 - 1 / 2) + 1 / 3) / 2)
    assert corpus.share_distance(a, b.filter("false")).first()[0] is None
    assert sorted(map(tuple, corpus.joined_counts(a, b).collect())) == [("x", 2, 1), ("y", 1, 0), ("z", 0, 1)]


def test_hamming_pairs_miss_none(spark):
    hashes = np.random.default_rng(4).integers(0, 1 << 16, 300).tolist() + [7, 7, 6]
    df = spark.createDataFrame(list(enumerate(hashes)), "k long, h long")
    want = sorted((i, j, (a ^ b).bit_count()) for j, b in enumerate(hashes) for i, a in enumerate(hashes[:j]) if (a ^ b).bit_count() <= 3)
    assert sorted(map(tuple, corpus.hamming_pairs(df, "k", "h", 3, bits=16, blocks=2).collect())) == want


def test_matches_by_id(spark):
    q = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "qid string, qidx long")
    g = spark.createDataFrame([("a_cap0", 0), ("a_cap1", 1), ("c_cap0", 2), ("a", 3)], "cid string, cidx long")
    assert sorted(map(tuple, pairs.matches_to_captions(q, g).collect())) == [("a", 0), ("a", 1), ("a", 3)]
    q2 = spark.createDataFrame([("a_cap0", 0), ("d_cap1", 1)], "qid string, qidx long")
    g2 = spark.createDataFrame([("a", 0), ("a", 4)], "cid string, cidx long")
    assert [tuple(x) for x in pairs.matches_to_images(q2, g2).collect()] == [("a_cap0", 4)]
    assert sorted(map(tuple, pairs.matches_to_images(q2, g2, last_only=False).collect())) == [("a_cap0", 0), ("a_cap0", 4)]
    assert sorted(map(tuple, pairs.first_match(q2, pairs.matches_to_images(q2, g2)).collect())) == [("a_cap0", 4), ("d_cap1", -1)]


def test_npz_bank_and_pair(spark, tmp_path):
    v = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.savez(tmp_path / "x.npz", embeddings=v, ids=np.array(["i0", "i1", "i2", "i3"]))
    rows = sorted(bank.read_npz(spark, str(tmp_path / "*.npz")).select("idx", "id", "v").collect())
    assert [(r.idx, r.id, r.v) for r in rows] == [(i, f"i{i}", v[i].tolist()) for i in range(4)]
    b = spark.createDataFrame([("q", 0, "test", "image", [3.0, 4.0]), ("t", 0, "val", "text", [1.0, 0.0]), ("u", 0, "test", "text", [0.0, 2.0])], "id string, idx long, split string, modality string, v array<double>")
    sinks.write_bank(b, str(tmp_path / "bank"))
    q, g = bank.pair(bank.scan(spark, str(tmp_path / "bank")), "i2t", gallery_splits=("test", "val"), normalize=True)
    assert q.first().v == pytest.approx([0.6, 0.8])
    assert sorted((x.cid, x.cidx) for x in g.collect()) == [("t", 1), ("u", 0)]
    with pytest.raises(ValueError):
        bank.pair(b, "x2y")


def test_tar_shards_and_pairs(spark, tmp_path):
    jpg = b"\xff\xd8\xff" + b"0" * 10
    with tarfile.open(tmp_path / "s.tar", "w") as tar:
        for name, data in {"1.jpg": jpg, "1.txt": b"one", "2.jpg": jpg, "2.json": b'{"caption": "two"}', "3.txt": b"alone", "4.jpg": b"bad", "4.txt": b"x"}.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    rows = source.tar_pairs(spark, str(tmp_path / "*.tar"))
    assert sorted((r.stem, r.caption, r.meta) for r in rows.collect()) == [("1", "one", None), ("2", None, '{"caption": "two"}'), ("4", "x", None)]
    assert sorted(r.stem for r in source.decodable(rows).collect()) in (["1", "2"], [])
    for split in ("train", "test"):
        (tmp_path / "tree" / split).mkdir(parents=True)
        (tmp_path / "tree" / split / "00000000.jpg").write_bytes(jpg)
        (tmp_path / "tree" / split / "00000000.txt").write_text("c " + split)
    (tmp_path / "tree" / "train" / "00000001.jpg").write_bytes(jpg)
    found = source.image_caption_pairs(spark, str(tmp_path / "tree"))
    assert sorted((r.split, r.stem, r.caption) for r in found.collect()) == [("test", "00000000", "c test"), ("train", "00000000", "c train")]
    m = corpus.manifest(found).collect()
    assert [r.split for r in m] == ["train", "test"] and m[0].jpeg_bytes == len(jpg)


def test_report_round_trip_and_guards(spark, tmp_path):
    rows = spark.createDataFrame([("CSLS", 1.5, 3), ("NNN", 2.5, 4)], "method string, a double, n long")
    report = sinks.nested_report(rows, {"k": 1}, "clip|i2t").first().report
    (tmp_path / "r.json").write_text(report)
    back = source.report_cells(spark, str(tmp_path / "r.json"))
    assert sorted((x.cell, x.method, x.n) for x in back.collect()) == [("clip|i2t", "CSLS", 3), ("clip|i2t", "NNN", 4)]
    assert json.loads(report)["config"] == {"k": "1"}
    assert "| CSLS | 1.5000 | 3 |" in sinks.markdown(rows.orderBy("method"), "T")
    (tmp_path / "bad.json").write_text('{"cells": [{"x": 1}]}')
    with pytest.raises(ValueError):
        source.report_cells(spark, str(tmp_path / "bad.json"))
    with pytest.raises(ValueError):
        source.stem_metadata(rows)
    with pytest.raises(ValueError):
        source.aliased(rows)
    assert source.parse_cells("a|i2t, b|t2i") == [("a", "i2t"), ("b", "t2i")]


def test_manifest_text_is_the_same_twice(spark):
    df = spark.createDataFrame([("train", "0", 'a "b"'), ("val", "1", None)], "split string, stem string, t string")
    one_, two = (sinks.csv_checksum(df.repartition(k).orderBy("stem")).first() for k in (1, 3))
    text = 'split,stem,t\n"train","0","a ""b"""\n"val","1",""\n'
    assert one_ == two and tuple(one_) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())


def test_bank_verification(spark):
    b = spark.createDataFrame([("a_0", 0, [1.0, 0.0]), ("a_0", 1, [2.0, 0.0]), ("b", 2, [1.0])], "id string, idx long, v array<double>")
    assert {r.rule: r.broken for r in corpus.verify_bank(b, 2, "^a_[0-9]+$").collect()} == {"dimension": 1, "id_format": 1, "repeated_ids": 1, "unit_norm": 1}


def test_embedding_is_deterministic(spark):
    df = one(spark, ["a text", "a text", None])
    v = [r.v for r in embed.embed_column(df, "x").collect()]
    assert v[0] == v[1] and len(v[0]) == 64 and np.linalg.norm(v[0]) == pytest.approx(1)
    assert embed.fixed_length(np.ones(5), 1, 10).tolist() == [1.0] * 5 + [0.0] * 5
    assert embed.fixed_length(np.ones((2, 40)), 1, 10, 20).shape == (10,)
    with pytest.raises(ValueError):
        embed.make_embedder("nothing")
    with pytest.raises(RuntimeError):
        embed.make_embedder("clip")


def test_stream_scoring_matches_batch(spark, tmp_path):
    from hubgate.plans.retrieval import Params, Retrieval
    from hubgate.streaming import score_stream

    rng = np.random.default_rng(9)
    norm = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(norm(rng.normal(size=(12, 4))))], "qid long, v array<double>")
    g = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(norm(rng.normal(size=(20, 4))))], "cid long, v array<double>")
    r = Retrieval(q, g, q.select("qid", F.lit(0).cast("long").alias("cid")), Params(csls_k=3))
    q.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    score_stream(stream, r.g.join(r.psi_wide, "cid"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {x.qid: (x.top1, x.certified) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {x.qid: (x.full, x.cert_global) for x in r.decisions.filter("method = 'CSLS'").collect()}


def test_registry_names_agree():
    from hubgate.plans import catalog

    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 100


def test_captions_by_image_digest_whole_texts(spark, tmp_path):
    import hashlib

    from hubgate.plans import corpus_queries

    head = "x" * 60
    rows = [("a", 0, head + " one"), ("a", 1, "z"), ("b", 2, head + " two"), ("b", 3, "z"), ("c", 5, "z"), ("c", 4, head + " one")]
    spark.createDataFrame(rows, "source string, doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.image: (r.n, r.digest) for r in corpus_queries.src11_captions_by_image(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = lambda *texts: (2, sha("|".join(sha(t) for t in texts)))
    assert got == {"a": want(head + " one", "z"), "b": want(head + " two", "z"), "c": want(head + " one", "z")}


def test_audio_is_embedded_whole(spark):
    quiet = [0.0] * 1500
    df = spark.createDataFrame([(quiet + [0.5, 0.25],), (quiet + [0.75, 0.125],), (quiet + [0.5, 0.25],), (None,)], "x array<float>")
    v = [r.v for r in embed.embed_column(df, "x", modality="audio").collect()]
    assert v[0] == v[2] and v[0] != v[1] and np.linalg.norm(v, axis=1) == pytest.approx(1.0)


class FakeBackend:
    """Remembers what it was given; vectors follow from it."""

    def __init__(self, **out):
        self.calls, self.out = [], out

    def decode(self, data):
        if data == b"broken":
            raise ValueError("no image")
        return ("decoded", data)

    def blank(self, width, height):
        return ("blank", width, height)

    def images(self, images):
        self.calls.append(images)
        return self.wrap(np.array([[3.0, 4.0 + len(str(x))] for x in images]))

    def texts(self, texts, padding):
        self.calls.append((texts, padding))
        return self.wrap(np.array([[len(t), 1.0] for t in texts]))

    def audio(self, samples, rate):
        self.calls.append((len(samples), rate))
        return np.array([[samples.sum(), 1.0]])

    def wrap(self, x):
        if self.out.get("states"):
            return (np.stack([x, x * 7], axis=1),)
        if self.out.get("hidden"):
            return SimpleNamespace(last_hidden_state=np.stack([x, x * 7], axis=1), pooler_output=None)
        return SimpleNamespace(pooler_output=x) if self.out.get("pooler") else x

    def project(self, modality, first):
        return first[:, ::-1]

    def metadata(self):
        return {"embedding_dim": 2}


def test_model_wrappers_follow_their_specs():
    unit = lambda rows, dtype: embed.unit_rows(np.array(rows, float)).astype(dtype)
    for kind, spec in embed.SPECS.items():
        backend = FakeBackend(states=spec.projected)
        model = embed.ModelEmbedder(spec, backend)
        texts = ["t" * (i % 5) for i in range(spec.batch + 3)]
        v = model.encode_texts(texts)
        assert v.dtype == np.dtype(spec.dtype) and [len(c[0]) for c in backend.calls] == [spec.batch, 3] and {c[1] for c in backend.calls} == {spec.padding}
        want = [[len(t), 1.0] for t in texts]
        assert np.array_equal(v, unit([w[::-1] for w in want] if spec.projected else want, spec.dtype))
        assert np.array_equal(model.encode_texts(texts[:2], normalize=False), np.array([w[::-1] if spec.projected else w for w in want[:2]], spec.dtype))
        assert model.get_metadata() == {"model_name": spec.name, "dtype": spec.dtype, "library": spec.library, "embedding_dim": "2"}
        backend.calls.clear()
        if spec.placeholder:
            model.encode_images([b"fine", b"broken", ("already", 1)])
            assert backend.calls == [[("decoded", b"fine"), ("blank", 224, 224), ("already", 1)]]
        else:
            with pytest.raises(ValueError):
                model.encode_images([b"broken"])
    for out in ({}, {"pooler": True}, {"hidden": True}):
        assert np.array_equal(embed.ModelEmbedder(embed.SPECS["siglip2"], FakeBackend(**out)).encode_texts(["ab"]), unit([[2, 1]], np.float32))
    assert embed.ModelEmbedder(embed.SPECS["clip"], FakeBackend()).encode_texts([]).shape == (0, 0)


def test_audio_goes_to_the_model_one_clip_at_a_time():
    backend = FakeBackend()
    model = embed.ModelEmbedder(embed.SPECS["clap"], backend)
    clips = [np.ones(48_000), np.ones((2, 24_000 * 11)), np.ones(100)]
    v = model.encode_audio(clips, [48_000, 24_000, 48_000])
    assert backend.calls == [(480_000, 48_000)] * 3 and v.dtype == np.float16 and v.shape == (3, 2)
    with pytest.raises(ValueError):
        embed.ModelEmbedder(embed.SPECS["clip"], backend).encode_audio(clips)


def test_registry_names_and_injected_backends(tmp_path):
    assert {"clip", "siglip", "laion", "clap", "blip", "clip_b16", "openclip_vit_h14", "eva_clip_l14"} <= set(embed.REGISTRY) and set(embed.TYPES_SINGLE) <= set(embed.REGISTRY)
    before = embed.REGISTRY["siglip2"]
    embed.use_backend("siglip2", FakeBackend)
    assert embed.embed_texts(["a"], "siglip2").dtype == np.float32 and embed.embed_images([b"x"], "siglip2").shape == (1, 2)
    embed.REGISTRY["siglip2"] = before
    assert not embed.only_pickled_weights(str(tmp_path))
    (tmp_path / "pytorch_model.bin").write_bytes(b"")
    assert embed.only_pickled_weights(str(tmp_path))
    (tmp_path / "model.safetensors").write_bytes(b"")
    assert not embed.only_pickled_weights(str(tmp_path))


def test_split_banks(spark):
    rows = [(0, b"a", ["x", "y"]), (3, None, ["gone"]), (5, b"b", ["z"]), (7, b"c", None)]
    samples = spark.createDataFrame(rows, "idx long, image binary, sentences array<string>")
    b = sorted((r.modality, r.idx, r.id, len(r.v)) for r in embed.split_bank(samples, "set", "val").collect())
    assert b == [("image", 0, "set_val_0", 64), ("image", 1, "set_val_5", 64), ("text", 0, "set_val_0_cap0", 64), ("text", 1, "set_val_0_cap1", 64), ("text", 2, "set_val_5_cap0", 64)]
    clips = spark.createDataFrame([(0, [0.5, 0.25], "one"), (1, [1.0], "two")], "idx long, audio array<float>, caption string")
    b = sorted((r.modality, r.id) for r in embed.split_bank(clips, "set", "val", modality="audio").collect())
    assert b == [("audio", "set_val_0"), ("audio", "set_val_1"), ("text", "set_val_0_cap0"), ("text", "set_val_1_cap0")]


def test_saved_datasets_are_detected_and_read(spark, tmp_path):
    info = {"features": {"id": {"dtype": "int64", "_type": "Value"}, "image": {"_type": "Image"}, "caption": [{"dtype": "string", "_type": "Value"}], "label": {"names": ["a"], "_type": "ClassLabel"}}}
    (tmp_path / "dataset_info.json").write_text(json.dumps(info, indent=1))
    data = pa.table({"id": [1, 2], "image": [{"bytes": b"x", "path": None}, None], "caption": [["c", "d"], []], "label": [0, None]}, schema=pa.schema([("id", pa.int64()), ("image", pa.struct([("bytes", pa.binary()), ("path", pa.string())])), ("caption", pa.list_(pa.string())), ("label", pa.int64())]))
    with pa.OSFile(str(tmp_path / "data-00000-of-00001.arrow"), "wb") as f, pa.ipc.new_stream(f, data.schema) as out:
        out.write_table(data)
    got = source.read_corpus(spark, str(tmp_path)).orderBy("id").collect()
    assert (got[0].id, bytes(got[0].image.bytes), got[0].caption, got[1].image, got[1].label) == (1, b"x", ["c", "d"], None, None)
    other = tmp_path / "csv"
    other.mkdir()
    (other / "a.csv").write_text("image,caption\nb.jpg,two\na.jpg,one\nb.jpg,three\n")
    assert source.detected_kind(spark, str(other)) == "csv" and source.read_corpus(spark, str(other)).count() == 3
    names = spark.createDataFrame([("b.jpg",), ("a.jpg",), ("c.jpg",)], "image string")
    assert [(r.idx, r.image, r.captions) for r in source.flickr_captions(spark, str(other / "a.csv"), names).orderBy("idx").collect()] == [(0, "a.jpg", ["one"]), (1, "b.jpg", ["two", "three"])]
    with pytest.raises(ValueError):
        source.detected_kind(spark, str(tmp_path / "nothing"))


def test_splits_of_data_sets(spark):
    images = spark.createDataFrame([("a", "train"), ("b", "restval"), ("c", None), ("d", "val"), ("", "test"), (None, "test")], "filename string, split string")
    assert sorted(map(tuple, source.organised_splits(images).collect())) == [("a", "train"), ("b", "train"), ("c", "train"), ("d", "val")]
    rows = spark.createDataFrame([(i, "train" if i < 4 else "validation") for i in range(6)], "i long, split string")
    got = sorted((r.split, r.i) for r in source.experiment_splits(rows, "i", 2).collect())
    assert got == [*[("train", i) for i in range(4)], ("train_calib", 0), ("train_calib", 1), ("val", 4), ("val", 5)]


def test_images_as_jpeg(spark):
    df = spark.createDataFrame([(1, b"\xff\xd8\xff")], "k int, image binary")
    assert source.jpeg_bytes(df).first().image == b"\xff\xd8\xff"
    text_ = source.jpeg_bytes(spark.createDataFrame([(1, "\xff\xd8中"), (2, None)], "k int, image string")).orderBy("k").collect()
    assert bytes(text_[0].image) == b"\xff\xd8?" and text_[1].image is None
    raw = spark.createDataFrame([(1, (1, 1, 3, b"\x01\x02\x03"))], "k int, image struct<height: int, width: int, nChannels: int, data: binary>")
    out = source.jpeg_bytes(raw).first().image
    assert out is None or bytes(out[:3]) == b"\xff\xd8\xff"


def test_command_line_lists_and_refuses(capsys):
    from hubgate.__main__ import main

    assert main([]) == 0 and "top2_shortlist" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["no such query", "--tables", "x"])
