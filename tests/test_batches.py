"""What a row gives goes out in bounded batches, before the rows after it are looked at."""

import pyarrow as pa
import pytest

from lodestone.functions import html
from lodestone.operators import batches, chunking, codegraph

PAGE = "<p>a</p>" * 3000
CODE = "import x from './lib';\nclass A {\n" + "  m(x) {\n    return this.f(x);\n  }\n" * 50 + "}\n"
PYTHON = "def f():\n    pass\n" * 3000
PROSE = ("x" * 3000 + "\n\n") * 20

CASES = {
    "outlines": (html.outlines, {"page_id": "k", "html": PAGE}, 3000),
    "elements": (html.elements, {"page_id": "k", "html": PAGE}, 3000),
    "code": (lambda f: chunking.chunk_code(f, "file"), {"file": "k", "text": PYTHON, "file_path": "a.py"}, 50),
    "prose": (lambda f: chunking.chunk_prose(f, "file"), {"file": "k", "text": PROSE, "file_path": "a.md"}, 20),
    "files": (chunking.chunk_files, {"file_path": "a.md", "text": PROSE}, 20),
    "nodes": (lambda f: codegraph.code_graph(f)[0], {"project_path": "p", "file_path": "a.ts", "text": CODE}, 3),
    "edges": (lambda f: codegraph.code_graph(f)[1], {"project_path": "p", "file_path": "a.ts", "text": CODE}, 2),
}


@pytest.mark.parametrize("name", CASES)
def test_results_go_out_in_bounded_batches(spark, monkeypatch, name):
    """The function given to Spark yields before its input of many rows is through, and never more than a batch of rows and characters."""
    make, row, least = CASES[name]
    files = spark.createDataFrame([tuple(row.values())], list(row))
    caught = []
    whole = type(files).mapInArrow
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, run, schema, *a, **b: caught.append((run, self.toArrow())) or whole(self, run, schema, *a, **b))
    made = make(files)
    (run, given), n = caught[0], made.count()
    assert n >= least
    batch, taken = given.combine_chunks().to_batches()[0], []

    def inputs():
        for i in range(600):
            taken.append(i)
            yield batch

    sizes, when = [], []
    for out in run(inputs()):
        sizes.append(out.num_rows)
        when.append(len(taken))
        assert out.num_rows <= batches.OUT_ROWS
        assert sum(len(x or "") for c in out.columns if pa.types.is_string(c.type) for x in c.to_pylist()) <= batches.OUT_CHARS * 1.2
    assert sum(sizes) >= 600 * least and (when[0] < 600 or sum(sizes) <= batches.OUT_ROWS)


def test_input_batches_are_bounded(spark):
    """Spark sends few large rows at a time, all of them, and a null key and an empty result hold."""
    rows = spark.range(0, 400, 1, 1).selectExpr("nullif(id, 7) AS id", "repeat('x', 200000) AS text")
    sent = batches.expanded(rows, 1, lambda text: [(len(text),)] * (len(text) > 1), {"n": "long"})
    assert sent.agg({"n": "sum"}).first()[0] == 400 * 200000 and sent.filter("id IS NULL").count() == 1
    most = rows.mapInArrow(lambda all_: (pa.RecordBatch.from_pydict({"n": [len(b)]}) for b in all_), "n long").agg({"n": "max"}).first()[0]
    assert most <= batches.IN_BYTES // 200000 + 2
    assert batches.expanded(rows, 1, lambda text: [], {"n": "long"}).count() == 0
