import io

import pytest
from pyspark.sql import functions as F

from lodestone.operators import additions, observability
from lodestone.sources import files, stores


def file_of(folder, name, text):
    (folder / name).write_bytes(text.encode())


@pytest.fixture
def incoming(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    file_of(folder, "a.pdf", "Scope plan\nThe scope is fixed.\fSecond page of it.")
    file_of(folder, "b.pdf", "Risk plan\nRisks are listed here.")
    file_of(folder, "c.pdf", "Risk plan\nRisks are listed here.")
    file_of(folder, "notes.txt", "no part of it")
    return folder


def state(store):
    rows = lambda t, *c: sorted(map(tuple, store.table(t).select(*c).collect()))
    return rows("documents", "doc_id", "title", "n_pages"), rows("pages", "doc_id", "page"), rows("chunks", "chunk_id"), rows("embeddings", "row_idx", "chunk_id", "dim")


def test_the_same_files_twice_add_nothing(spark, incoming, tmp_path):
    store = stores.Store(spark, str(tmp_path / "s"))
    assert additions.add(store, files.files(spark, str(incoming)), strategy="fixed", dimensions=16) == additions.Added(2, 3, 3, 1)
    before = state(store)
    assert [r[0] for r in before[3]] == [0, 1, 2] and {r[2] for r in before[3]} == {16}
    assert additions.add(store, files.files(spark, str(incoming))) == additions.Added(0, 0, 0, 3)
    assert state(store) == before and store.manifest().version == 1
    file_of(incoming, "d.pdf", "Cost plan\nCosts are low.\fMore about costs.")
    assert additions.add(store, files.files(spark, str(incoming)), strategy="sentence_window") == additions.Added(1, 2, 2, 3)
    after = state(store)
    assert set(before[3]) < set(after[3]) and [r[0] for r in after[3]] == list(range(5))  # numbers go on, nothing is embedded anew
    assert all("-fixed-" in r[0] for r in after[2]) and {r[2] for r in after[3]} == {16}  # the strategy and size that the store has
    assert {r[1] for r in after[3]} == {r[0] for r in after[2]}


def test_what_fails_half_way_leaves_the_store(spark, incoming, tmp_path, monkeypatch):
    store = stores.Store(spark, str(tmp_path / "s"))
    additions.add(store, files.files(spark, str(incoming)), dimensions=8)
    before = state(store)
    file_of(incoming, "d.pdf", "Another one")
    part = store.part

    def broken(name, rows):
        if name == "embeddings":
            raise OSError("the machine is gone")
        return part(name, rows)

    monkeypatch.setattr(store, "part", broken)
    with pytest.raises(OSError):
        additions.add(store, files.files(spark, str(incoming)))
    assert state(stores.Store(spark, store.path)) == before
    monkeypatch.undo()
    assert additions.add(store, files.files(spark, str(incoming))).documents == 1
    assert store.vacuumed() == 3 and state(store)[0] != before[0]  # three parts of the change that failed
    assert all(stores.readable(store, t) for t in stores.TABLES)


def test_stages_are_timed_counted_and_logged(spark, incoming, tmp_path, monkeypatch):
    store, metrics, log = stores.Store(spark, str(tmp_path / "s")), observability.Metrics(spark, "run", str(tmp_path / "m")), observability.Log(spark, "run", str(tmp_path / "l"))
    additions.add(store, files.files(spark, str(incoming)), dimensions=8, metrics=metrics, log=log)
    got = {(r["stage"], r["metric_name"]): r["value"] for r in observability.metric_rows(spark, metrics.path).collect()}
    assert got["ingest", "documents.count"] == 2 and got["ingest", "duplicates.count"] == 1 and got["chunking", "chunks.count"] == got["index_vector", "chunks.indexed"] == 3
    assert all(got[s, f"{s}.seconds"] > 0 for s in ("ingest", "chunking", "index_vector"))
    monkeypatch.setattr(store, "part", lambda *given: 1 / 0)
    file_of(incoming, "d.pdf", "Another one")
    with pytest.raises(ZeroDivisionError):
        additions.add(store, files.files(spark, str(incoming)), metrics=metrics, log=log)
    events = [(r["level"], r["stage"], r["event"]) for r in observability.log_rows(spark, log.path).orderBy("timestamp").collect()]
    assert events == [("info", s, e) for s in ("ingest", "chunking", "index_vector") for e in ("start", "complete")] + [("info", "ingest", "start"), ("error", "ingest", "failed")]


def test_two_changes_at_once(spark, incoming, tmp_path):
    store = stores.Store(spark, str(tmp_path / "s"))
    before = store.manifest()
    additions.add(store, files.files(spark, str(incoming)), dimensions=8)
    with pytest.raises(stores.Changed):
        store.commit(before, {"pages": []})
    assert store.manifest().version == 1 and store.table("pages", before).count() == 0


def test_stream_of_files(spark, incoming, tmp_path, monkeypatch):
    store = stores.Store(spark, str(tmp_path / "s"))
    run = lambda: additions.additions(store, str(incoming), str(tmp_path / "at"), most_files=2, strategy="fixed", dimensions=8).awaitTermination()
    run()
    first = state(store)
    assert len(first[0]) == 2 and sorted(r[0] for r in first[3]) == [0, 1, 2]
    file_of(incoming, "d.pdf", "Later one")
    commit = store.commit

    def then_killed(*given):
        commit(*given)
        raise OSError("killed after the commit, before the checkpoint")

    monkeypatch.setattr(store, "commit", then_killed)
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.undo()
    once = state(store)
    run()
    assert state(store) == once and len(once[0]) == 3 and stores.readable(store, "chunks")


def test_removal_numbers_anew(spark, incoming, tmp_path):
    store = stores.Store(spark, str(tmp_path / "s"))
    additions.add(store, files.files(spark, str(incoming)), dimensions=8)
    doc = store.table("documents").where("n_pages = 2").first()["doc_id"]
    assert additions.remove(store, doc) and not additions.remove(store, doc)
    assert [len(x) for x in state(store)] == [1, 1, 1, 1] and state(store)[3][0][0] == 0
    assert additions.row_counts(store) == {t: 1 for t in stores.TABLES}


def test_embeddings_of_two_models(spark, incoming, tmp_path):
    store = stores.Store(spark, str(tmp_path / "s"))
    additions.add(store, files.files(spark, str(incoming)), dimensions=8)
    mixed = store.table("embeddings").withColumn("embedding_model", F.when(F.col("row_idx") == 0, "x").otherwise("y"))
    with pytest.raises(ValueError, match="embedding_model"):
        additions.index_of(mixed)
    store.replace(lambda m: {"embeddings": store.table("embeddings", m).withColumn("provider", F.lit("ollama"))})
    file_of(incoming, "d.pdf", "Another one")
    with pytest.raises(ValueError, match="ollama"):
        additions.add(store, files.files(spark, str(incoming)))


def test_uploads(spark, tmp_path):
    given = [("../x/one.PDF", b"first text"), ("", io.BytesIO(b"second text")), ("two", bytearray(b"third text")), ("two", b"in its place")]
    paths = additions.received(spark, str(tmp_path / "up"), given)
    assert [p.rsplit("/", 1)[1] for p in paths] == ["one.PDF", "upload_2.pdf", "two.pdf", "two.pdf"]
    assert (tmp_path / "up" / "two.pdf").read_bytes() == b"in its place"
    with pytest.raises(TypeError):
        additions.received(spark, str(tmp_path / "up"), [("x", "text")])
