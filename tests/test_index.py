"""The gene index, readers and table rules on hand-made inputs."""

import itertools
import math
import random
from collections import Counter

import pytest

from loomfield.operators import enrichment as enr
from loomfield.operators import geneindex as gi
from loomfield.operators import summary
from loomfield.sources import readers, tables

EXPR = "dataset string, fov string, cell_id long, label string, gene string, value double"


@pytest.fixture(scope="module")
def expr(spark):
    rows = [("d", "f", i, "AB"[i % 2], g, float(1 + (i * k) % 7)) for k, g in ((1, "x"), (2, "y"), (3, "z")) for i in range(30) if i % (k + 1)]
    return spark.createDataFrame(rows, EXPR).cache()


@pytest.mark.parametrize("bits", [2, 8, 10])
def test_quantiles_are_those_of_the_normal_distribution(expr, bits):
    index = gi.build(expr, bits)
    rows = {(r.gene, r.cell_id): r.value for r in expr.collect()}
    for r in index.collect():
        for cell, q in zip(r.cell_ids, r.quantiles, strict=True):
            share = math.erfc(-(math.log(rows[r.gene, cell]) - r.mu) / r.sigma / math.sqrt(2)) / 2
            assert abs(q - share * 2**bits) <= 1 + 1e-6 and 0 <= q < 2**bits
    back = {(r.gene, r.cell_id): r.value for r in gi.expression_of(index).collect()}
    assert back.keys() == rows.keys()
    if bits == 10:
        assert all(abs(math.log(back[k] / v)) < 0.02 for k, v in rows.items())


def test_merge_refuses_other_bits(expr):
    with pytest.raises(ValueError):
        gi.merge(gi.build(expr, 2), gi.build(expr, 3))
    with pytest.raises(ValueError):
        gi.build(expr, 32)
    assert gi.merge(gi.build(expr), gi.build(expr)).count() == 6
    assert {r.cell_id for r in gi.posting(gi.build(expr), 1).collect()} == {i for i in range(30) if i % 3}


def test_search_names_in_any_case(expr):
    index = gi.build(expr)
    assert {r.cell_id for r in gi.search(index, ["X", "y"]).collect()} == {i for i in range(30) if i % 2 and i % 3}
    assert gi.marker_genes(expr, ["X", "Y", "Z"], 30, exhaustive=True).count() == 4
    assert gi.support_cutoff(expr, ["x", "y"]) == 1


def test_unknown_datasets(spark):
    cells = spark.createDataFrame([("a", "a_0", 1, "A", 0.0, 0.0)], "dataset string, fov string, cell_id long, label string, x double, y double")
    assert tables.of_datasets(cells, "a").count() == 1
    with pytest.raises(ValueError):
        tables.of_datasets(cells, ["a", "b"])
    with pytest.raises(ValueError):
        enr.differential(cells, "A", ["a", "b"], [["A"]])


def test_concat(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (1, "y", 1.0)], "cell_id long, gene string, value double")
    b = spark.createDataFrame([(2, "y", 2.0), (2, "z", 2.0)], "cell_id long, gene string, value double")
    assert {r.gene for r in tables.concat([a, b]).collect()} == {"y"} and tables.concat([a, b], outer=True).count() == 4


def test_csv(spark, tmp_path):
    (tmp_path / "cells.csv").write_text("barcode,slide,batch,kind,px,py\n1,s,b,A,0.5,1\n2,s,b,B,1.5,2\n3,s,b,,1,1\n")
    found = readers.read_cells(spark, f"{tmp_path}/cells.csv", "px", "py", "kind", "barcode", "slide", "batch")
    assert [(r.cell_id, r.label, r.x) for r in found.orderBy("cell_id").collect()] == [(1, "A", 0.5), (2, "B", 1.5)]
    with pytest.raises(ValueError):
        readers.read_cells(spark, f"{tmp_path}/cells.csv")
    (tmp_path / "wide.csv").write_text("cell_id,x,y\n1,0,2.5\n2,1,\n")
    (tmp_path / "long.csv").write_text("cell_id,gene,value\n1,y,2.5\n2,x,1\n2,y,0\n")
    for path, gene in (("wide", None), ("long", "gene")):
        assert {tuple(r) for r in readers.read_expression(spark, f"{tmp_path}/{path}.csv", gene=gene).collect()} == {(1, "y", 2.5), (2, "x", 1.0)}


def test_annotated_matrix_by_ranges(monkeypatch):
    """The reader's partitions and rows, over a stand-in for the file."""
    import numpy as np

    class Held(dict):
        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

    file = Held(
        obsm={"X_spatial": np.array([[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]])},
        obs={"predicted_label": {"categories": np.array([b"A", b"B"]), "codes": np.array([1, -1, 0])}},
        var={"gene_ids": np.array([b"g", b"h", b"g"])},
        X={"indptr": np.array([0, 2, 2, 4]), "indices": np.array([0, 2, 1, 2]), "data": np.array([1.0, 9.0, 2.0, 9.0])},
    )
    for table, want in (("cells", [("ST", "ST_0", 0, "B", 0.0, 1.0), ("ST", "ST_0", 1, None, 2.0, 3.0), ("ST", "ST_0", 2, "A", 4.0, 5.0)]), ("expression", [(0, "g", 1.0), (2, "h", 2.0)])):
        reader = readers.AnnotatedMatrix({"path": "p", "table": table, "rows": "2"}).reader(None)
        monkeypatch.setattr(type(reader), "_open", lambda self: file)
        parts = reader.partitions()
        assert [p.value for p in parts] == [(0, 2), (2, 3)] and [row for p in parts for row in reader.read(p)] == want


def test_frames_behind_figures(spark):
    found = spark.createDataFrame([(["a", "b"], "d1", 0.01), (["c"], "d1", 0.001), (["b"], "d2", 0.2)], "itemset array<string>, higher string, adj_p_value double")
    rows = {(r.motif_group, r.label): round(r.neg_log10_p, 6) for r in summary.differential_matrix(found).collect()}
    assert rows == {("d1_motif_1", "a"): 2.0, ("d1_motif_1", "b"): 2.0, ("d1_motif_2", "c"): 3.0}
    pairs = spark.createDataFrame([("t", a, b, s, True) for a, b, s in (("g", "h", 1.0), ("h", "g", 2.0), ("g", "k", -1.0))] + [("t", "x", "y", 5.0, False)], "cell_type string, gene_center string, gene_motif string, combined_score double, if_significant boolean")
    assert {(r.sign, r.gene_center, r.score) for r in summary.pair_matrix(pairs).collect()} == {("positive", "g", 1.0), ("positive", "h", 2.0)}


def test_sums_by_cell_in_parts(spark, small, monkeypatch):
    """More lines make more parts, not larger sums in one; the values are the same."""
    want = {tuple(r) for r in tables.orders_as_expression(spark, small).collect()}
    monkeypatch.setattr(tables, "ROWS", 500)
    found = tables.orders_as_expression(spark, small)
    parts = found.rdd.glom().map(len).collect()
    assert len(parts) >= tables.read(spark, small, "lineitem").count() / 500 and max(parts) < 1500 and {tuple(r) for r in found.collect()} == want


def test_gene_patterns_of_any_length(spark):
    """Sets of every length that enough cells hold, by plain enumeration: none is left out for its five genes or six."""
    rng = random.Random(5)
    held = [sorted(rng.sample("ABCDEFG", rng.randint(1, 7))) for _ in range(60)]
    expr = spark.createDataFrame([("d", "f", i, "l", g, 1.0) for i, own in enumerate(held) for g in own], "dataset string, fov string, cell_id long, label string, gene string, value double")
    counts = Counter(s for own in held for n in range(2, 8) for s in itertools.combinations(own, n))
    want = {s: c for s, c in counts.items() if c >= 12}
    assert {tuple(r.itemset): r.freq for r in gi.gene_patterns(expr, min_cells=12).collect()} == want and max(map(len, want)) > 4
