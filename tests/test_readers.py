import gzip
import os

import pytest

from junctura.container import CountSet, event_pairs, make_exclusion, namespace, validate_pair
from junctura.sources import mtx, read_genes, read_junctions, read_velocity
from junctura.sources.files import lines
from junctura.sources.names import make_unique
from junctura.sources.spatial import per_sample, tissue_positions


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    (gzip.open(path, "wt") if path.endswith(".gz") else open(path, "w")).write(text)


def matrix(rows):
    cells = [(i + 1, j + 1, v) for i, r in enumerate(rows) for j, v in enumerate(r) if v]
    body = "".join(f"{i} {j} {v}\n" for i, j, v in cells)
    return f"%%MatrixMarket matrix coordinate integer general\n%\n{len(rows)} {len(rows[0])} {len(cells)}\n{body}"


def junction_sample(root, junctions, counts, barcodes=None):
    root = str(root)
    write(f"{root}/SJ.out.tab", "".join("\t".join(map(str, (*j, 0, 30))) + "\n" for j in junctions))
    write(f"{root}/Solo.out/SJ/raw/matrix.mtx", matrix(counts))
    write(f"{root}/Solo.out/SJ/raw/barcodes.tsv", "".join(f"{b}\n" for b in barcodes or [f"AC{'ACGT'[i]}" for i in range(len(counts[0]))]))
    return f"{root}/Solo.out/SJ"


#: Three junctions with one start, two with one end, and one alone.
MIXED = [("7", 40, 90, 2, 0, 1, 9), ("7", 40, 95, 2, 0, 0, 2), ("7", 40, 99, 2, 0, 1, 3), ("X", 10, 70, 1, 2, 0, 8), ("X", 30, 70, 1, 2, 0, 1), ("9", 5, 6, 0, 0, 0, 4)]
MIXED_COUNTS = [[2, 0, 1], [0, 3, 4], [6, 1, 0], [8, 0, 2], [0, 5, 1], [4, 4, 4]]


def test_junctions_of_one_sample(spark, tmp_path):
    got = read_junctions(spark, [junction_sample(tmp_path / "s", MIXED, MIXED_COUNTS)], ["s"], use_internal_whitelist=False)
    var = got.var.orderBy("feature_idx").collect()
    assert got.obs.count() == 3 and "".join(r.group_kind for r in var) == "SSSEE" and "".join(r.strand for r in var) == "---++"
    assert [r.group_id for r in var] == [0, 0, 0, 1, 1] and {r.chr for r in var} == {"7", "X"}
    pairs = {(r.event_idx, r.cell_idx): (r.m1, r.m2) for r in event_pairs(make_exclusion(got)).collect()}
    assert pairs[0, 0] == (2, 6) and pairs[1, 2] == (4, 1) and pairs[0, 1] == (0, 4) and pairs[3, 1] == (0, 5)


def test_a_junction_can_be_two_events(spark, tmp_path):
    rows = [("4", 11, 22, 1, 1, 0, 2), ("4", 11, 33, 1, 1, 0, 2), ("4", 8, 22, 1, 1, 0, 2)]
    got = read_junctions(spark, [junction_sample(tmp_path / "s", rows, [[2, 0], [1, 1], [3, 5]])], ["s"], use_internal_whitelist=False)
    own = got.var.where("start = 11 and end = 22").select("feature_idx", "group_kind").collect()
    assert sorted(r.group_kind for r in own) == ["E", "S"]
    sums = {r.feature_idx: r.s for r in got.layers["M1"].groupBy("feature_idx").sum("value").withColumnRenamed("sum(value)", "s").collect()}
    assert {sums[r.feature_idx] for r in own} == {2}


def test_samples_complete_groups(spark, tmp_path):
    a = junction_sample(tmp_path / "a", [("4", 11, 22, 2, 1, 1, 9)], [[2, 9]])
    b = junction_sample(tmp_path / "b", [("4", 11, 44, 2, 1, 1, 9)], [[1, 6]])
    got = read_junctions(spark, [a, b], ["a", "b"], use_internal_whitelist=False)
    rows = got.layers["M1"].join(got.obs, "cell_idx").collect()
    assert got.var.count() == 2 and sum(r.value for r in rows if r.sample_id == "a") == 11 and sum(r.value for r in rows if r.sample_id == "b") == 7
    assert {r.cell for r in got.obs.collect()} == {"ACA-a", "ACC-a", "ACA-b", "ACC-b"}


def test_matrices_are_checked(spark, tmp_path):
    path = junction_sample(tmp_path / "s", MIXED, MIXED_COUNTS)
    text = open(f"{path}/raw/matrix.mtx").read()
    write(f"{path}/raw/matrix.mtx", text[: text.rindex("\n", 0, -1) + 1])
    with pytest.raises(ValueError, match="cut off"):
        read_junctions(spark, [path], ["s"], use_internal_whitelist=False)
    write(f"{tmp_path}/m.mtx", "%%MatrixMarket matrix coordinate real symmetric\n3 3 3\n1 1 2\n3 1 5\n2 2 7\n")
    assert {(r.row, r.col): r.value for r in mtx.entries(spark, f"{tmp_path}/m.mtx").collect()} == {(0, 0): 2, (2, 0): 5, (0, 2): 5, (1, 1): 7}


def test_names_that_look_numbered(spark):
    rows = spark.createDataFrame(list(enumerate(["A", "A-1", "A", "A", "A-3", "A-1", "B", "A"])), "i long, s string")
    assert [r.name for r in make_unique(rows, "s", "i", "name").orderBy("i").collect()] == ["A", "A-1", "A-2", "A-4", "A-3", "A-1-1", "B", "A-5"]
    odd = spark.createDataFrame([(0, None), (1, "nan"), (2, None), (3, "nan-1")], "i int, s string").repartition(3)
    assert [r.name for r in make_unique(odd, "s", "i", "name").orderBy("i").collect()] == ["nan", "nan-2", "nan-3", "nan-1"]


def test_filters_and_errors(spark, tmp_path):
    rows = [("chr1", 100, 200, 1, 1, 1, 5), ("chr1", 100, 300, 1, 1, 1, 0), ("chr1", 100, 400, 1, 1, 1, 3)]
    path = junction_sample(tmp_path / "s", rows, [[3, 4], [5, 5], [2, 1]])
    read = lambda **k: read_junctions(spark, [path], ["s"], use_internal_whitelist=False, **k)
    assert read().var.count() == 2 and read(keep_multi_mapped=True).var.count() == 3
    with pytest.warns(UserWarning, match="no other of their group"), pytest.raises(ValueError, match="no group has two"):
        read(min_counts=5)
    with pytest.raises(ValueError, match="ljv_kind"):
        read(ljv_kind="both")
    with pytest.raises(ValueError, match="below 0"):
        read(min_counts=-1)
    with pytest.raises(ValueError, match="repeated names"):
        read_junctions(spark, [path, path], ["s", "s"])
    with pytest.raises(ValueError, match="dash"):
        read_junctions(spark, [path], ["s-1"])
    with pytest.raises(FileNotFoundError):
        read_junctions(spark, [str(tmp_path / "none")], ["s"])
    write(f"{path}/raw/barcodes.tsv", "ACA\n")
    with pytest.raises(ValueError, match="dimension mismatch"):
        read()


def test_whitelist_and_positions(spark, tmp_path):
    path = junction_sample(tmp_path / "s", MIXED[:2], [[1, 2, 3], [4, 5, 6]], ["AAA", "CCC", "GGG"])
    got = read_junctions(spark, [path], ["s"], barcode_whitelists=[["AAA", "GGG"]])
    assert [r.barcode for r in got.obs.orderBy("cell_idx").collect()] == ["AAA", "GGG"] and got.meta["whitelist_source"] == {"s": "explicit"}
    v2 = "barcode,In_Tissue,array_row,array_col,pxl_row_in_fullres,pxl_col_in_fullres\nAAA,1,0,2,10,20\nGGG,0,1,3,30,40\n"
    write(str(tmp_path / "v2.csv"), v2)
    write(str(tmp_path / "v1.csv"), v2.split("\n", 1)[1])
    write(str(tmp_path / "bad.csv"), "barcode,in_tissue\nAAA,1\n")
    assert tissue_positions(spark, str(tmp_path / "v1.csv")).collect() == tissue_positions(spark, str(tmp_path / "v2.csv")).collect()
    with pytest.raises(ValueError, match="lacks"):
        tissue_positions(spark, str(tmp_path / "bad.csv"))
    with pytest.warns(UserWarning, match="passed over"):
        spatial = read_junctions(spark, [path], ["s"], barcode_whitelists=[["AAA"]], tissue_positions=str(tmp_path / "v2.csv"))
    assert [(r.barcode, r.spatial, r.array_col) for r in spatial.obs.orderBy("cell_idx").collect()] == [("AAA", [20.0, 10.0], 2), ("GGG", [40.0, 30.0], 3)]


def gene_sample(root, genes, counts, em=None, filtered=None, zipped=False):
    z, raw = ".gz" if zipped else "", f"{root}/Solo.out/Gene/raw"
    barcodes = [f"AC{'ACGTN'[i]}" for i in range(len(counts[0]))]
    write(f"{raw}/matrix.mtx{z}", matrix(counts))
    write(f"{raw}/barcodes.tsv{z}", "".join(f"{b}\n" for b in barcodes))
    write(f"{raw}/features.tsv{z}", "".join("\t".join(g) + "\n" for g in genes))
    if em:
        write(f"{raw}/UniqueAndMult-EM.mtx", matrix(em))
    if filtered:
        write(f"{root}/Solo.out/Gene/filtered/barcodes.tsv", "".join(f"{barcodes[i]}\n" for i in filtered))
    return str(root)


def values(counts, layer):
    names = counts.layers[layer].join(counts.var, "feature_idx").join(counts.obs, "cell_idx").collect()
    return {(r.gene_id, r.cell): r.value for r in names}


def test_genes(spark, tmp_path):
    g = [("G1", "A", "x"), ("G2", "B", "x")]
    std, em = [[1, 2, 3, 4], [5, 6, 7, 8]], [[101, 102, 103, 104], [105, 106, 107, 108]]
    got = read_genes(spark, [gene_sample(tmp_path / "a", g, std, em, [0, 2])], ["a"])
    assert values(got, "X") == {("G1", "ACA-a"): 101, ("G1", "ACG-a"): 103, ("G2", "ACA-a"): 105, ("G2", "ACG-a"): 107}
    two = read_genes(spark, [gene_sample(tmp_path / "b", [("G1", "D"), ("G2", "D"), ("G3", "U")], [[1], [0], [2]], zipped=True), gene_sample(tmp_path / "c", [("G2", "D"), ("G4", "E")], [[4, 5], [6, 0]])], ["b", "c"], use_internal_whitelist=False, var_names="gene_symbols")
    assert [(r.gene_id, r.name, r.feature_type) for r in two.var.orderBy("feature_idx").collect()] == [("G1", "D", "Gene Expression"), ("G2", "D-1", "Gene Expression"), ("G3", "U", "Gene Expression"), ("G4", "E", "Gene Expression")]
    assert values(two, "X") == {("G1", "ACA-b"): 1, ("G3", "ACA-b"): 2, ("G2", "ACA-c"): 4, ("G2", "ACC-c"): 5, ("G4", "ACA-c"): 6}
    with pytest.raises(ValueError, match="var_names"):
        read_genes(spark, [str(tmp_path / "a")], ["a"], var_names="ids")
    with pytest.raises(FileNotFoundError):
        read_genes(spark, [str(tmp_path / "a")], ["a"], matrix_file="other.mtx")


def test_velocity(spark, tmp_path):
    raw = f"{tmp_path}/s/Solo.out/Velocyto/raw"
    write(f"{raw}/barcodes.tsv", "ACA\nACC\n")
    write(f"{raw}/features.tsv", "G1\tA\tx\nG2\tB\tx\n")
    write(f"{raw}/matrix.mtx", matrix([[1, 2], [3, 4], [5, 0], [0, 6], [7, 7], [0, 8]]))
    stacked = read_velocity(spark, [f"{tmp_path}/s"], ["s"], use_internal_whitelist=False)
    assert values(stacked, "spliced") == {("G1", "ACA-s"): 1, ("G1", "ACC-s"): 2, ("G2", "ACA-s"): 3, ("G2", "ACC-s"): 4}
    assert values(stacked, "ambiguous") == {("G1", "ACA-s"): 7, ("G1", "ACC-s"): 7, ("G2", "ACC-s"): 8} and stacked.layers["X"] is stacked.layers["spliced"]
    for n, m in (("spliced", [[1, 2], [3, 4]]), ("unspliced", [[5, 0], [0, 6]])):
        write(f"{raw}/{n}.mtx", matrix(m))
    with pytest.raises(FileNotFoundError, match="ambiguous"):
        read_velocity(spark, [f"{tmp_path}/s"], ["s"])
    write(f"{raw}/ambiguous.mtx", matrix([[7, 7], [0, 8]]))
    split = read_velocity(spark, [f"{tmp_path}/s"], ["s"], use_internal_whitelist=False)
    assert all(values(split, n) == values(stacked, n) for n in ("spliced", "unspliced", "ambiguous"))
    write(f"{raw}/matrix.mtx", matrix([[1, 2]] * 5))
    for n in ("spliced", "unspliced", "ambiguous"):
        os.remove(f"{raw}/{n}.mtx")
    with pytest.raises(ValueError, match="stacked matrix of 5 rows"):
        read_velocity(spark, [f"{tmp_path}/s"], ["s"], use_internal_whitelist=False)


def test_matrix_details(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m.mtx")
    write(path, "%%MatrixMarket\n% c\n3 2 3\n3 2 3\n1 1 2\n1 1 5\n")
    assert {(r.row, r.col): r.value for r in mtx.entries(spark, path).collect()} == {(2, 1): 3, (0, 0): 7}
    assert mtx.shape(spark, path) == (3, 2, 3)
    monkeypatch.setenv("JUNCTURA_MAX_MTX_NNZ", "2")
    with pytest.raises(ValueError, match="nnz"):
        mtx.shape(spark, path)
    write(str(tmp_path / "l.txt"), "a\n\nb\nc\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        assert [(r.line_idx, r.value) for r in lines(spark, str(tmp_path / "l.txt")).orderBy("line_idx").collect()] == [(0, "a"), (1, "b"), (2, "c")]
        spark.conf.set("spark.sql.files.openCostInBytes", "20b")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20b")  # comments and dimension line begin in the first block
        assert {(r.row, r.col): r.value for r in mtx.entries(spark, path).collect()} == {(2, 1): 3, (0, 0): 7}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    with pytest.raises(ValueError, match="for 2 samples|for"):
        per_sample(["a"], 2, "x")


def test_container(spark, tmp_path):
    got = make_exclusion(read_junctions(spark, [junction_sample(tmp_path / "s", MIXED, MIXED_COUNTS)], ["s"], use_internal_whitelist=False))
    got.save(str(tmp_path / "saved"))
    again = CountSet.load(spark, str(tmp_path / "saved"))
    assert again.meta == got.meta and sorted(again.layers["M2"].collect()) == sorted(got.layers["M2"].collect())
    validate_pair(again.select_cells(again.obs.where("cell_idx < 2")))
    with pytest.raises(RuntimeError):
        validate_pair(again.select_features(again.var.where("feature_idx < 2")))
    with pytest.raises(KeyError):
        validate_pair(CountSet(got.obs, got.var, {"M1": got.layers["M1"]}))
    with pytest.warns(FutureWarning):
        assert namespace({"older": {"m2_valid": True}}, "older") == {"m2_valid": True}
