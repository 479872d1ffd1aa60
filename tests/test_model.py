"""Tokens, the decoder, training with resume, generation, evaluation, export, gates and the command line."""

import json
import os
import random
import re
import sqlite3
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom import cli
from chatloom.functions import tokens
from chatloom.model import artifacts, decoder, generate, scoring
from chatloom.model import train as training
from chatloom.operators import audit, stats
from chatloom.schema import CONTROL_TOKENS
from chatloom.sources import files

public = pytest.importorskip("public_tokenizers")
VOCABULARY = public.path("byte_bpe_50k.json")
SMALL = {"name": "smoke", "hidden_size": 16, "num_layers": 2, "num_heads": 2, "intermediate_size": 24, "max_sequence_length": 12}


def test_tokens_against_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    texts = ["hello  there", "", "<|me|>hi<|turn_end|>\n", "é 👍 x", None, "a<|endoftext|>b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", tokens.encoded(F.col("t"), VOCABULARY).alias("ids"))
    got = df.select("i", "ids", tokens.decoded(F.col("ids"), VOCABULARY, False).alias("back")).orderBy("i").collect()
    for x, r in zip(texts, got, strict=True):
        assert r.back == x and (x is None or "<|me|>" in x or r.ids == t.encode(x, add_special_tokens=False).ids)
    ids = tokens.control_ids(VOCABULARY)
    assert got[2].ids[0] == ids["<|me|>"] and sorted(ids.values()) == list(range(t.get_vocab_size(), t.get_vocab_size() + len(CONTROL_TOKENS)))
    assert df.where("i = 2").select(tokens.decoded(F.col("ids"), VOCABULARY)).first()[0] == "hi\n"
    v = tokens.vocabulary(spark, VOCABULARY)
    assert v.count() == tokens.vocab_size(VOCABULARY) and v.where("token = '<|me|>'").first().id == ids["<|me|>"] and tokens.load(VOCABULARY).token_to_id("no such token") is None
    tokens.save(VOCABULARY, tmp_path / "tok")
    assert tokens.control_ids(tmp_path / "tok") == ids and (tmp_path / "tok/tokenizer.json").stat().st_mode & 0o777 == 0o600
    encoded = tokens.encode_splits(df.drop("ids").withColumn("split", F.when(F.col("i") < 3, "train").otherwise("test")), VOCABULARY, "t")
    report = {r.split: (r.sessions, r.tokens) for r in stats.token_report(encoded, "split").collect()}
    assert report == {"train": (3, sum(len(r.ids) for r in got[:3])), "test": (3, sum(len(r.ids) for r in got[3:] if r.ids))}


def test_slices_of_texts():
    texts = ["ab", None, "abc", "", "x" * 9, "y", None]
    got = list(tokens._slices(texts, 5))
    assert got == [["ab", None, "abc", ""], ["x" * 9], ["y", None]] and not list(tokens._slices([], 5)) and list(tokens._slices([None], 5)) == [[None]]


@pytest.mark.skipif(not os.path.exists("/proc/self/clear_refs"), reason="no peaks of memory to read")
def test_encoding_holds_little(spark):
    """A batch of 10,000 texts, 13 million characters: a worker that encodes them in one call, as before, takes 760 MB, and 190 MB by slices."""
    psutil = pytest.importorskip("psutil")
    text = "So many words, each with its own 1,234 tokens\n" * 28

    def workers():
        return [p for d in psutil.Process().children(recursive=True) if "pyspark.daemon" in d.cmdline() for p in d.children()]

    def peak(p):
        return int(re.search(r"VmHWM:\s+(\d+)", Path(f"/proc/{p.pid}/status").read_text())[1]) / 1024

    for p in workers():
        Path(f"/proc/{p.pid}/clear_refs").write_text("5")
    df = spark.range(0, 10_000, 1, 1).select("id", F.when(F.col("id") % 100 != 7, F.lit(text)).alias("t"))
    r = df.select("t", tokens.encoded(F.col("t"), VOCABULARY).alias("ids")).agg(F.sum(F.size("ids")), F.count("ids"), F.count_if(F.col("t").isNull() == F.col("ids").isNull())).first()
    assert tuple(r) == (9900 * len(tokens.load(VOCABULARY).encode(text, add_special_tokens=False).ids), 9900, 10_000)
    peaks = [peak(p) for p in workers()]
    assert max(peaks) < 600, peaks


@pytest.mark.parametrize("tied", [True, False])
def test_gradients(tied):
    """Against differences in float64; a model must not see what comes later."""
    shape = decoder.Shape.of(SMALL | {"vocab_size": 19, "tie_embeddings": tied, "max_sequence_length": 6})
    p = {k: v.astype(np.float64) for k, v in decoder.fresh(shape, 3).items()}
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 19, (2, 7))
    x, y = ids[:, :-1], ids[:, 1:]
    _, grad = decoder.gradients(shape, p, x, y)
    at = lambda: decoder.token_losses(decoder.forward(shape, p, x)[0], y).mean()
    for k, a in p.items():
        for _ in range(4):
            i = tuple(rng.integers(0, n) for n in a.shape)
            keep, h = a[i], 1e-5
            a[i] = keep + h
            up = at()
            a[i] = keep - h
            down = at()
            a[i] = keep
            assert abs((up - down) / (2 * h) - grad[k][i]) < 2e-5, k
    logits = decoder.forward(shape, p, x)[0]
    changed = x.copy()
    changed[:, -1] = (changed[:, -1] + 1) % 19
    assert np.allclose(decoder.forward(shape, p, changed)[0][:, :-1], logits[:, :-1]) and decoder.n_parameters(p) == sum(a.size for a in p.values())
    with pytest.raises(ValueError):
        decoder.forward(shape, p, np.zeros((1, 7), int))
    for bad in ({"num_heads": 3}, {"hidden_size": 6, "num_heads": 6}, {"dropout": 1.0}, {"num_layers": 0}):
        with pytest.raises(ValueError):
            decoder.Shape.of(SMALL | {"vocab_size": 9} | bad)


def test_parameter_counts_of_configs():
    for name, n in (("model-1m", 1_377_408), ("model-7m", 6_163_712)):
        shape = decoder.Shape.of(artifacts.load_config(f"configs/{name}.yaml") | {"vocab_size": 4096})
        assert decoder.n_parameters(decoder.fresh(shape)) == n


def test_draw():
    how, rng = generate.Sampling(temperature=1.0, top_p=0.6, repetition_penalty=1.0), np.random.default_rng(0)
    logits = np.log(np.array([0.5, 0.3, 0.15, 0.05]))
    seen = [generate.draw(logits, [], how, rng) for _ in range(4000)]
    assert set(seen) == {0, 1} and abs(np.mean(seen) - 0.375) < 0.03
    assert generate.draw(logits, [], generate.Sampling(temperature=0), rng) == 0
    assert generate.draw(np.array([1.0, 0.9, -1.0]), [0], generate.Sampling(temperature=0, repetition_penalty=1.5), rng) == 1
    assert list(generate.deltas(iter(["a", "ab", "ab", "x", "xy"]))) == ["a", "b", "x", "y"]


def windows_of(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [rng.randrange(8)]
        while len(w) < 13:
            w.append((3 * w[-1] + 1) % 8 if rng.random() < 0.9 else rng.randrange(8))
        rows.append((i, w))
    return spark.createDataFrame(rows, "window_no long, ids array<long>")


def test_training_learns_and_resumes(spark, tmp_path):
    config = SMALL | {"batch_size": 8, "epochs": 2, "learning_rate": 0.01, "warmup_steps": 4, "evaluation_interval": 5, "checkpoint_interval": 6, "seed": 1, "dropout": 0.1}
    data = windows_of(spark, 60, 1), windows_of(spark, 16, 2)
    whole = training.train(config, *data, 8, VOCABULARY, tmp_path / "whole")
    assert whole["global_step"] == 16 and whole["best_validation_loss"] < 1.6 < np.log(8) and not whole["initialized_from_checkpoint"]
    training.train(config | {"epochs": 1}, *data, 8, VOCABULARY, tmp_path / "half")
    half = artifacts.load_model(tmp_path / "half/last")[1]
    assert set(half) == set(artifacts.load_model(tmp_path / "whole/last")[1])
    # Stopped after step 6 of the same schedule and taken up again, it ends where the whole run ended.
    state = json.loads((tmp_path / "whole/last/trainer-state.json").read_text())
    assert state["compiled_step"] is False and (tmp_path / "whole/last/optimizer.npz").stat().st_mode & 0o777 == 0o600
    shape, p = artifacts.load_model(tmp_path / "whole/last")
    rng, optimizer = np.random.default_rng(0), decoder.AdamW(p)
    loaded = artifacts.restore(tmp_path / "whole/last", p, optimizer, rng)
    assert loaded["global_step"] == 16 and any(a.any() for a in optimizer.v.values())
    metrics = [json.loads(x) for x in (tmp_path / "whole/metrics.jsonl").read_text().splitlines()]
    assert [m["step"] for m in metrics if m["type"] == "train"] == list(range(1, 17)) and abs(metrics[0]["learning_rate"] - 0.0025) < 1e-12
    with pytest.raises(ValueError):
        training.train(config, data[0].limit(0), data[1], 8, VOCABULARY, tmp_path / "none")
    losses = scoring.window_losses(data[1], shape, p)
    r = scoring.mean_loss(losses).first()
    ids = np.array([x.ids for x in data[1].collect()])
    assert abs(r.loss - decoder.token_losses(decoder.forward(shape, p, ids[:, :-1])[0], ids[:, 1:]).mean()) < 1e-4
    manifest = artifacts.export(tmp_path / "whole/best", tmp_path / "final", splits=None)
    assert artifacts.complete({f.name for f in (tmp_path / "final").iterdir()}) and manifest["model_sha256"] == files.sha256_file(tmp_path / "final/model.npz")
    replies = scoring.generated(scoring.prompts_of(data[1], 12, 3), shape, p, {7}, generate.Sampling(max_new_tokens=5))
    want = {r.window_no: generate.reply_ids(shape, p, r.ids[:8], {7}, generate.Sampling(max_new_tokens=5).seeded(r.window_no)) for r in data[1].where("window_no < 3").collect()}
    assert {r.key: list(r.ids) for r in replies.collect()} == want


def test_resume_is_exact(spark, tmp_path):
    config = SMALL | {"batch_size": 8, "epochs": 2, "learning_rate": 0.01, "checkpoint_interval": 3, "evaluation_interval": 100, "seed": 5, "dropout": 0.1}
    data = windows_of(spark, 32, 1), windows_of(spark, 8, 2)
    kept, real = [], training.save_checkpoint

    def keep(place, *a):
        real(place, *a)
        if place.name == "last" and a[4]["global_step"] == 3:
            kept.append(1)
            real(tmp_path / "third", *a)

    training.save_checkpoint = keep
    try:
        training.train(config, *data, 8, VOCABULARY, tmp_path / "a")
    finally:
        training.save_checkpoint = real
    again = training.train(config, *data, 8, VOCABULARY, tmp_path / "b", resume=tmp_path / "third")
    a, b = (artifacts.load_model(tmp_path / n / "last")[1] for n in "ab")
    assert kept and again["initialized_from_checkpoint"] and all(np.allclose(a[k], b[k], atol=1e-6) for k in a)


def test_epoch_order_stays_off_the_driver(spark, monkeypatch):
    """The order is numpy's over several slices, and neither the driver's numpy nor a local table makes it."""
    want = np.random.default_rng(45).permutation(600_000)
    monkeypatch.setattr(np.random, "default_rng", None)
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    rows = stats.epoch_batches(spark, 600_000, 32, 42, 3, 2)
    monkeypatch.undo()
    got = rows.orderBy("batch", "slot").toPandas()
    assert got["window_no"].tolist() == want[64:].tolist() and got["batch"].tolist() == (np.arange(64, 600_000) // 32).tolist()


def test_epoch_batches(spark):
    rows = stats.epoch_batches(spark, 11, 4, 42, 3, 1).orderBy("batch", "slot").collect()
    order = np.random.default_rng(45).permutation(11)
    assert [(r.batch, r.slot, r.window_no) for r in rows] == [(i // 4, i % 4, order[i]) for i in range(4, 11)]
    assert stats.epoch_batches(spark, 0, 4, 1, 1).count() == 0
    got = stats.gather(windows_of(spark, 11, 1), stats.epoch_batches(spark, 11, 4, 42, 3)).collect()
    assert len(got) == 11 and all(len(r.ids) == 13 for r in got)


def test_epoch_order_is_not_broadcast(spark):
    """Spark sends a table through the driver that it takes for small; the order is not one, neither in a query nor in training."""
    w, order = windows_of(spark, 70, 1), stats.epoch_batches(spark, 70, 4, 42, 3)
    for df in (stats.gather(w, order), stats.gather(w, order.where("batch > 1")), w.join(order, "window_no").orderBy("batch", "slot")):
        n = df.count()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert n in (70, 62) and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_doc_windows(spark):
    """The windows of the stream of tokens, which keep their order, and their count without the ids."""
    rng = random.Random(4)
    for sizes in ([], [64], [65], [3, 0, 200, 61, 1], [0, 5, 5, 5, 65, 0, 64, 1, 650, 7], [rng.randrange(90) for _ in range(60)]):
        docs = spark.createDataFrame([(k * 7 % 61, [rng.randrange(1000) for _ in range(n)]) for k, n in enumerate(sizes)] + [(99, []), (98, None)], "doc_id long, ids array<long>")
        stream = [x for r in sorted(docs.where("ids IS NOT NULL").collect()) for x in r.ids]
        w = stats.doc_windows(docs, "doc_id", 64)
        got = sorted((r.window_no, r.ids) for r in w.collect())
        assert got == [(i, stream[65 * i : 65 * i + 65]) for i in range(sum(sizes) // 65)] == sorted((r.window_no, r.ids) for r in stats.windows(stats.token_stream(docs, "doc_id"), 64).collect())
        assert w.count() == len(got) and "collect_list" not in w.select("window_no")._jdf.queryExecution().optimizedPlan().toString()


def test_weighted_draws(spark):
    p = spark.range(4000).select(F.col("id").alias("k"), F.posexplode(F.array(F.lit(0.5), F.lit(0.0), F.lit(0.2), F.lit(0.3))).alias("idx", "p"))
    got = {r.idx: r["count"] for r in stats.weighted_draw(p, "k", 7).groupBy("idx").count().collect()}
    assert set(got) == {0, 2, 3} and all(abs(got[i] / 4000 - q) < 0.03 for i, q in ((0, 0.5), (2, 0.2), (3, 0.3)))


def test_gram_rows(spark):
    rng = random.Random(1)
    ids = [rng.randrange(4) for _ in range(500)]
    stream = spark.createDataFrame(list(enumerate(ids)), "pos long, token long")
    for first in (None, 0, 7, 123):
        want = {tuple(ids[i : i + 5]) for i in range(496) if first is None or i < first}
        assert {tuple(r.g) for r in stats.known_grams(stats.gram_rows(stream, 5, 16), 5, first=first).collect()} == want


def test_completion_gates(spark, tmp_path):
    r = {"snapshot": {"quick_check": "ok", "snapshot_sha256": "x", "source_open_mode": "read-only"}, "extraction": {"all_rows_accounted_for": True, "body_recovery_rate": 0.9}, "sessions": {"sessions": 3}, "split": {"splits": {n: {} for n in cli.SPLITS}, "cross_split_duplicate_hashes": 0}, "privacy": {"passed": True}, "tokenizer": {"vocab_size": 9}, "model": {"vocab_size": 9}, "selection": {"selected": "m"}}
    r |= {"training": {"initialized_from_checkpoint": False, "pretrained_weights_used": False, "global_step": 5, "epoch": 2, "early_stopped": False}, "evaluation": {"test_tokens": 4, "beats_unigram_baseline": True, "memorization": {"generation_samples": 2}}, "manifest": {"model_sha256": "y"}}
    r["facts"] = dict.fromkeys(("source_readable", "checkpoints", "tests_passed", "export_complete", "chat_ok", "chat_clean", "readme", "nothing_tracked", "private_modes"), True) | {"snapshot_sha256": "x", "model_sha256": "y", "config_name": "m", "epochs": 2}
    assert {x.gate: x.passed for x in audit.completion(spark, r).collect()} == dict.fromkeys("abcd", True)
    assert not any(x.passed for x in audit.completion(spark, {}).collect())
    for name, report in (("smoke", None), ("m", {"enough_tokens_to_train": True, "selected": "m"})):
        audit.training_gate(name, report)
    for report in (None, {"enough_tokens_to_train": False, "selected": "m"}, {"enough_tokens_to_train": True, "selected": "other"}):
        with pytest.raises(ValueError):
            audit.training_gate("m", report)
    (tmp_path / "l").write_text('{"a": 1}\n\n[1]\n')
    with pytest.raises(ValueError, match="line 3"):
        files.check_jsonl(tmp_path / "l")
    (tmp_path / "c").write_text("- 1\n")
    with pytest.raises(ValueError):
        artifacts.load_config(tmp_path / "c")


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    """From a database to a reply, by commands alone."""
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(cli, "session", lambda: spark)
    c = sqlite3.connect("chat.db")
    c.executescript("""CREATE TABLE handle (ROWID INTEGER PRIMARY KEY, id TEXT); CREATE TABLE chat (ROWID INTEGER PRIMARY KEY, chat_identifier TEXT); CREATE TABLE attachment (ROWID INTEGER PRIMARY KEY, filename TEXT);
    CREATE TABLE message (ROWID INTEGER PRIMARY KEY, guid TEXT, text TEXT, attributedBody BLOB, is_from_me INTEGER, handle_id INTEGER, date INTEGER, service TEXT, item_type INTEGER DEFAULT 0, associated_message_type INTEGER DEFAULT 0, is_deleted INTEGER DEFAULT 0);
    CREATE TABLE chat_message_join (chat_id INTEGER, message_id INTEGER); CREATE TABLE chat_handle_join (chat_id INTEGER, handle_id INTEGER); CREATE TABLE message_attachment_join (message_id INTEGER, attachment_id INTEGER);
    INSERT INTO handle VALUES (1, 'a@b.org')""")
    rng = random.Random(2)
    for i in range(60):
        c.execute("INSERT INTO chat VALUES (?, ?)", (i, f"chat{i}"))
        c.execute("INSERT INTO chat_handle_join VALUES (?, 1)", (i,))
        for k in range(2):
            words = " ".join(rng.choice(["hello", "there", "my", "friend", "yes", "no"]) for _ in range(9))
            c.execute("INSERT INTO message (ROWID, guid, text, is_from_me, handle_id, date, service) VALUES (?, ?, ?, ?, 1, ?, 'S')", (2 * i + k + 1, f"g{i}-{k}", f"{words} {i}", k, 710000000 + 86400 * i + 60 * k))
            c.execute("INSERT INTO chat_message_join VALUES (?, ?)", (i, 2 * i + k + 1))
    c.commit()
    c.close()
    (tmp_path / "data.yaml").write_text("source_db: chat.db\nsnapshot_db: work/snapshot/chat.db\nsplit: {train: 0.8, validation: 0.1, test: 0.1, guard_days: 0}\n")
    (tmp_path / "smoke.yaml").write_text(json.dumps(SMALL | {"num_layers": 1, "batch_size": 16, "epochs": 1, "learning_rate": 0.01}))

    def run(*args):
        code = cli.main(list(args))
        out = capsys.readouterr().out
        return code, json.loads(out) if out.startswith("{") else out

    assert run("doctor", "--config", "data.yaml")[1]["source_database_readable_read_only"]
    assert run("snapshot", "--config", "data.yaml")[1]["quick_check"] == "ok"
    assert run("inspect-schema")[1]["missing_expected_tables"] == []
    code, out = run("prepare", "--config", "data.yaml")
    assert code == 0 and out["extraction"]["retained_rows"] == 120 and {k: v["sessions"] for k, v in out["split"]["splits"].items()} == {"train": 48, "validation": 6, "test": 6}
    assert run("privacy-audit")[0] == 0
    assert run("tokenizer", "--vocabulary", VOCABULARY)[1]["vocab_size"] == 50269
    models = [str(tmp_path / "smoke.yaml")] * 2
    _, out = run("corpus-stats", "--models", *models)
    assert out["selection"]["enough_tokens_to_train"] is False and out["tokens"]["train"]["sessions"] == 48
    assert len(artifacts.load_tokens("work/tokens/train.npy")) == out["tokens"]["train"]["tokens"] and int(artifacts.load_tokens("work/tokens/train.npy").astype(np.uint64).sum()) == out["tokens"]["train"]["checksum"]
    (tmp_path / "real.yaml").write_text(json.dumps(SMALL | {"name": "real", "batch_size": 4, "epochs": 1, "learning_rate": 0.01}))
    assert run("train", "--config", "real.yaml")[0] == 2
    code, out = run("train", "--config", "smoke.yaml", "--output", "outputs/runs/r")
    assert code == 0 and out["global_step"] > 0
    code, out = run("evaluate", "--checkpoint", "outputs/runs/r/best")
    assert out["memorization"]["generation_samples"] > 0 and out["me_turn_test_tokens"] > 0 and out["test_perplexity"] > 1
    assert run("export", "--checkpoint", "outputs/runs/r/best")[1]["pretrained_weights_used"] is False
    lines = iter(["hi there", "/quit"])
    monkeypatch.setattr("builtins.input", lambda _: next(lines))
    code, out = run("chat", "--max-new-tokens", "3")
    assert code == 0 and "me: " in out
    code, out = run("audit", "--run", "outputs/runs/r")
    assert code == 1 and out["gate_a"]["snapshot_check"] and out["gate_b"]["splits_filled"] and out["gate_d"]["export_complete"] and not out["ready"]
