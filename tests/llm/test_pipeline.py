"""The pipeline's stages against plain Python, on one small corpus; and the entry point with and without this subpackage."""

import os
import shutil
import subprocess
import sys
from collections import Counter

import corpus_pipeline
import pytest
from plain import SPACES, LOWER, base_counts, components, edited, hits, prose

from plumbline.llm import frames

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain_lines(rows):
    docs = {}
    for d, t in rows:
        for line in (t or "").split("\n") if d is not None else ():
            docs.setdefault(line.strip(SPACES).translate(LOWER), set()).add(d)
    out = []
    for d, t in rows:
        keep = []
        for line in (t or "").split("\n"):
            key = line.strip(SPACES).translate(LOWER)
            if d is None or len(key) < 20 or len(docs.get(key, ())) < 3 or d == max(docs[key]):
                keep.append(line)
        out.append((d, None if t is None else "\n".join(keep)))
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    base, item = prose(100, 1), prose(40, 2)
    rows = [(i, f"{prose(80, 10 + i)}\nThe same footer line here\n{prose(30, 40 + i)}") for i in range(10)]
    rows += [(20 + i, edited(base, 0.01, i)) for i in range(5)] + [(30, f"{prose(100, 60)} {item} {prose(60, 61)}"), (31, f"{prose(900, 62)} {item[:120]}")]
    rows += [(40, "too short"), (41, None), (42, ""), (43, " ".join(["again and again"] * 60)), (None, prose(70, 70)), (None, None), (5, rows[5][1]), (50, prose(5000, 71))]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, kept int")
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "near-duplicate removal", "benchmark decontamination", "best-fit packing"]

    def step(name, docs):
        out = frames.written(stages[name](spark, docs, folder))
        assert out.columns == columns or name == "best-fit packing"
        return out, Counter((r.doc_id, r.text) for r in out.select("doc_id", "text").collect()) if "text" in out.columns else None

    def passes(text):
        c = base_counts(text)
        return c[0] >= 50 and 100 * c[4] <= 50 * c[0]

    rows = [r for r in rows if passes(r[1])]
    docs, made = step("quality rules", docs)
    assert made == Counter(rows)
    rows = plain_lines(rows)
    docs, made = step("line dedup", docs)
    assert made == Counter(rows) and docs.where("n_chars <> length(text)").isEmpty()
    classes, seen = components(rows), set()
    rows = [r for r in rows if r[0] is None or classes[r[0]] == r[0]]
    rows = [r for r in rows if r[0] is None or not (r[0] in seen or seen.add(r[0]))]
    docs, made = step("near-duplicate removal", docs)
    assert made == Counter(rows) and {20, 5} <= {d for d, _ in rows} and 21 not in {d for d, _ in rows}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [r for r in rows if not hits(r[1], items)[4]]
    docs, made = step("benchmark decontamination", docs)
    assert made == Counter(rows) and {30, 31} & {d for d, _ in rows} == {31}
    packed = stages["best-fit packing"](spark, docs, folder).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 1024
    whole = corpus_pipeline.run(spark, folder).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, whole[key].values.tolist())) == sorted(map(str, packed[key].values.tolist()))


def test_stages_take_an_empty_table(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


@pytest.mark.parametrize("absent", [False, True])
def test_entry_point(tmp_path, absent):
    """The queries are there; without the subpackage and its tests the rest still imports."""
    for name in ("catalog", "plumbline", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            skip = ["__pycache__", *["llm"] * absent]
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns(*skip))
        elif not (absent and name.startswith("corpus")):
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; print(*[q for q in e.queries() if q == 'pipeline' or q.startswith('op')], len(e.queries()) > 100)"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""}, check=True)
    names = said.stdout.split()
    assert names[-1] == "True"
    assert names[:-1] == [] if absent else {n.split("_")[0] for n in names[:-1]} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}
