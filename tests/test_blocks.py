"""The distributed column layout: products against numpy, ADMM against the row layout and row-level updates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from proxlab.functions.prox import prox_np
from proxlab.operators import blocks, linalg, solvers
from proxlab.operators.numbering import numbered
from proxlab.sources import text

M, N = 120, 19


@pytest.fixture(scope="module")
def problem():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(M, N)) * (rng.random((M, N)) < 0.4)
    a[:, 18] = 1.0           # a dense column
    a[:, 5] = a[30:60] = 0   # a column and a row block without entries
    return a, rng.normal(size=M)


def frames(spark, a, b, height, width):
    cols = spark.createDataFrame([(j, a[:, j].tolist()) for j in range(a.shape[1])], "feat_id long, features array<double>")
    vec = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "feat_id long, value double")
    return blocks.from_column_lines(cols, height, width), blocks.row_vector(vec, len(b), height)


def dense(parts, matrix, n):
    out = np.zeros(n)
    for r in parts.collect():
        lo = r.cb * matrix.col_block
        out[lo:lo + len(r.part)] += r.part
    return out


@pytest.mark.parametrize("height,width,one_pass", [(25, 4, False), (30, 64, True), (1000, 1, False)])
def test_products_equal_numpy(spark, problem, height, width, one_pass):
    a, b = problem
    matrix, rhs = frames(spark, a, b, height, width)
    assert matrix.one_pass == one_pass and abs(matrix.trace - (a * a).sum()) < 1e-9 and matrix.entries == (a != 0).sum()
    w = np.linspace(-1, 1, N)
    vec = spark.createDataFrame([(k, w[k * width:(k + 1) * width].tolist()) for k in range(-(-N // width))], "cb long, w array<double>")
    vec = matrix.column_blocks().join(matrix.local(vec, "w"), "cb")
    assert np.allclose(dense(matrix.product_parts(vec), matrix, N), a.T @ (a @ w), atol=1e-12)
    r = {x.rb: x.r for x in matrix.forward(vec).collect()}
    assert np.allclose(np.concatenate([r.get(k, np.zeros(min(height, M - k * height))) for k in range(-(-M // height))]), a @ w)
    assert np.allclose(dense(matrix.backward_parts(matrix.with_columns(matrix.local(rhs, "b"))), matrix, N), a.T @ b)
    coo = spark.createDataFrame([(int(i), int(j), float(a[i, j]) / 2) for i, j in zip(*np.nonzero(a)) for _ in (0, 1)], "row_id long, feat_id int, value double")
    other = blocks.from_entries(coo, M, N, row_block=height, col_block=width)
    vec = other.column_blocks().join(other.local(vec.select("cb", "w"), "w"), "cb")
    assert np.allclose(dense(other.product_parts(vec), other, N), a.T @ (a @ w), atol=1e-12)
    matrix.close(), other.close()


@pytest.mark.parametrize("momentum,line_search,width", [(False, False, 6), (True, False, 64), (True, True, 6)])
def test_admm_equals_the_row_layout(spark, problem, momentum, line_search, width):
    a, b = problem
    matrix, rhs = frames(spark, a, b, 50, width)
    rows = spark.createDataFrame([(float(b[i]), a[i].tolist()) for i in range(M)], "label double, features array<double>")
    op = linalg.make_operator(rows, N)
    kw = dict(lam=3.0, beta=0.1, u=3.0 / op.trace, maxit=5, momentum=momentum, line_search=line_search)
    want, got = solvers.admm(op, **kw), blocks.admm(matrix, rhs, **kw)
    out = got.weights().orderBy("feat_id").collect()
    assert [r.feat_id for r in out] == list(range(N))
    assert np.allclose([r.weight for r in out], want.x, atol=1e-10) and np.allclose([r.extrapolated for r in out], want.z, atol=1e-10)
    assert got.step == want.step and got.iterations == want.iterations == 5
    matrix.close()


def row_level_admm(a, b, lam, beta, u, maxit, tol):
    """The updates on rows, with their own p and y: (x, iterations)."""
    m, n = a.shape
    x, p, y = np.zeros(n), np.zeros(m), np.zeros(m)
    for k in range(1, maxit + 1):
        ax = a @ x
        p = p + beta * (ax - y)
        y = (beta * ax + b + p) / (1 + beta)
        old, x = x, prox_np("l1", x - u * (a.T @ (ax - y + p / beta)), lam * u / beta)
        if tol and np.linalg.norm(ax - y) <= tol * np.linalg.norm(b) and np.linalg.norm(x - old) <= tol * max(np.linalg.norm(old), 1):
            break
    return x, k


def test_stops_where_the_row_level_updates_stop(spark, problem):
    a, b = problem
    rows = spark.createDataFrame([(float(b[i]), a[i].tolist()) for i in range(M)], "label double, features array<double>")
    op = linalg.make_operator(rows, N)
    kw = dict(lam=0.5, beta=0.5, u=1.0 / op.trace * 6)
    for tol in (0.2, 0.05, 0.02):
        x, k = row_level_admm(a, b, kw["lam"], kw["beta"], kw["u"], 200, tol)
        got = solvers.admm(op, **kw, maxit=200, tol=tol)
        assert 1 < k < 200 and got.iterations == k and np.allclose(got.x, x, atol=1e-9)
    x, k = row_level_admm(a, b, kw["lam"], kw["beta"], kw["u"], 200, 0.2)
    matrix, rhs = frames(spark, a, b, 50, 64)
    got = blocks.admm(matrix, rhs, **kw, maxit=200, tol=0.2)
    assert got.iterations == k and np.allclose([r.weight for r in got.weights().orderBy("feat_id").collect()], x, atol=1e-9)
    matrix.close()


def test_bad_columns_are_errors(spark):
    make = lambda rows: blocks.from_column_lines(spark.createDataFrame(rows, "feat_id long, features array<double>"))
    for rows, said in (([], "empty"), ([(0, [1.0]), (1, [1.0, 2.0])], "unequal"), ([(0, [1.0]), (2, [1.0])], "numbered"), ([(0, [1.0]), (0, [1.0])], "numbered")):
        with pytest.raises(ValueError, match=said):
            make(rows)
    with pytest.raises(Exception, match="no number"):
        make([(0, [1.0, None])])
    for rows in ([(0, 1.0)], [(0, 1.0), (0, 2.0)], [(0, 1.0), (1, None)], [(0, 1.0), (2, 1.0)]):
        with pytest.raises(ValueError, match="one number"):
            blocks.row_vector(spark.createDataFrame(rows, "feat_id long, value double"), 2)


def test_column_text_round_trip(spark, tmp_path):
    a = np.array([[0.1, 0.0], [1e-17, 3.0], [-2.5, 0.0]])
    rows = spark.createDataFrame([(i, a[i].tolist()) for i in (2, 0, 1)], "row_id long, features array<double>")
    text.write_column_lines(linalg.to_coo(rows, ["row_id"], keep_zeros=True), str(tmp_path / "at"))
    got = {(r.row_id, r.feat_id): r.value for r in text.read_column_entries(spark, str(tmp_path / "at")).collect()}
    assert got == {(i, j): a[i, j] for i, j in zip(*np.nonzero(a))}


def test_long_columns_are_read_in_pieces(spark, tmp_path):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(230, 3)) * (rng.random((230, 3)) < 0.7)
    rows = spark.createDataFrame([(i, a[i].tolist()) for i in range(230)], "row_id long, features array<double>").repartition(5)
    path = str(tmp_path / "at")
    text.write_column_lines(linalg.to_coo(rows, ["row_id"], keep_zeros=True), path, piece=16)
    # no line holds more than a piece, and a column goes on over lines and files
    assert spark.read.text(path).selectExpr("max(size(split(value, ',')))").first()[0] == 16 and spark.read.text(path).count() == 3 * 15
    got = {(r.row_id, r.feat_id): r.value for r in text.read_column_entries(spark, path).collect()}
    assert got == {(i, j): a[i, j] for i, j in zip(*np.nonzero(a))}
    pieces = text.read_column_pieces(spark, path)
    assert pieces.selectExpr("max(size(features))").first()[0] == 16
    matrix = blocks.from_column_lines(pieces, 25, 2)
    assert (matrix.m, matrix.n, matrix.entries) == (230, 3, (a != 0).sum()) and abs(matrix.trace - (a * a).sum()) < 1e-9
    vec = matrix.column_blocks().join(matrix.local(spark.createDataFrame([(0, [1.0, -2.0]), (1, [0.5])], "cb long, w array<double>"), "w"), "cb")
    assert np.allclose(dense(matrix.product_parts(vec), matrix, 3), a.T @ (a @ [1.0, -2.0, 0.5]), atol=1e-12)
    matrix.close()
    with pytest.raises(ValueError, match="numbered"):
        blocks.from_column_lines(pieces.where("start <> 32"))


def test_lines_go_on_over_files_and_splits(spark, tmp_path):
    (tmp_path / "p").mkdir()
    for name, said in (("a", "1,2\\\n3\\\n"), ("b", "4\n5,6\n"), ("c", "7\\\n"), ("d", "8,9"), ("e", "0,1.5\n")):
        (tmp_path / "p" / name).write_text(said)
    got = {(r.row_id, r.feat_id): r.value for r in text.read_column_entries(spark, str(tmp_path / "p")).collect()}
    want = [[1, 2, 3, 4], [5, 6], [7, 8, 9], [0, 1.5]]
    assert got == {(i, j): v for j, line in enumerate(want) for i, v in enumerate(line) if v}


def test_numbered_rows(spark):
    rows = [(i % 7, f"v{i % 3}") for i in range(50)] + [(None, "n")] * 2 + [(3, "v0")] * 30
    df = spark.createDataFrame(rows, "k long, part string").repartition(6)
    got, total = numbered(df, [F.col("k"), F.col("part")], "row_no")
    out = sorted(got.collect(), key=lambda r: r.row_no)
    assert total == len(rows) and [r.row_no for r in out] == list(range(len(rows)))
    keys = [(r.k is not None, r.k or 0, r.part) for r in out]
    assert keys == sorted(keys)
    empty, none = numbered(df.limit(0), [F.col("k")], "row_no")
    assert none == 0 and empty.count() == 0


def test_written_strips_are_read_some_at_a_time(spark):
    """Before, a task decoded 4,096 strips at once: some 800 MB of whole strips, however small their file."""
    a = np.random.default_rng(3).normal(size=(40, 5))
    for row_block in (16, blocks.ROW_BLOCK, 1 << 24):
        matrix, rhs = frames(spark, a, a @ np.ones(5), row_block, 2)
        rows = int(matrix.spark.conf.get("spark.sql.parquet.columnarReaderBatchSize"))
        assert rows == 1 or rows * row_block * blocks.ENTRY_BYTES <= blocks.READ_BYTES
        assert matrix.local(rhs, "b").sparkSession.conf.get("spark.sql.parquet.columnarReaderBatchSize") == str(rows)
        assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096" and matrix.entries == 200
        matrix.close()
