"""Tables whose last slice lacks lines, as any number of vectors that is no multiple of 25 gives."""

import duckdb
import pyarrow.parquet as pq
import pytest

from voxspark.jobs import catalog

from .test_queries import same

LINES = 513


@pytest.fixture(scope="module")
def incomplete(tmp_path_factory):
    folder = tmp_path_factory.mktemp("incomplete")
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    pq.write_table(table.sort_by("vec_id").slice(0, LINES), folder / "embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    return str(folder), db


def equal(spark, incomplete, name):
    folder, db = incomplete
    df = catalog.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    want = sorted(db.execute(f"SELECT {', '.join(columns)} FROM ({catalog.SQL[name]})").fetchall())
    return len(got) == len(want) and all(same(x, y) for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))


@pytest.mark.parametrize(
    "name",
    ["edge_mask_chunked_fixed", "edge_mask_chunked_moving", "edge_mask_with_mask", "edge_mask_with_mask_chunked", "edge_moments", "interp_masked", "lcc_value", "lcc_candidates", "lcc_candidates_chunked", "descent_pass", "lcc_derivatives", "lcc_derivatives_affine"],
)
def test_masks_of_voxels_that_are_there(spark, incomplete, name):
    assert equal(spark, incomplete, name)


def test_a_file_gives_back_the_voxels_of_its_table(spark, incomplete):
    assert equal(spark, incomplete, "mhd_round_trip")


@pytest.mark.parametrize("name", ["transform_block_chunked", "transform_mask_chunked", "resample_linear_chunked"])
def test_grids_have_the_voxels_of_their_image(spark, incomplete, name):
    assert equal(spark, incomplete, name)


def test_an_image_moves_within_its_voxels(spark, incomplete):
    assert equal(spark, incomplete, "shifted_volume")


@pytest.fixture(scope="module")
def gappy(tmp_path_factory):
    """Lines are missing inside of slices, and a whole slice."""
    folder = tmp_path_factory.mktemp("gappy")
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").sort_by("vec_id").slice(0, LINES).to_pandas()
    table = table[~table.vec_id.isin([137, 210, 211, 212, 340, *range(400, 425)])]
    table.to_parquet(folder / "embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    return str(folder), db


@pytest.mark.parametrize("name", ["edge_mask_chunked_fixed", "edge_mask_chunked_moving", "edge_mask_moving", "edge_mask_with_mask_chunked", "edge_moments", "interp_masked", "lcc_candidates", "lcc_candidates_chunked"])
def test_masks_of_images_with_gaps(spark, gappy, name):
    assert equal(spark, gappy, name)


@pytest.mark.parametrize("name", ["lcc_derivatives", "lcc_derivatives_affine"])
def test_slopes_of_images_with_gaps(spark, gappy, name):
    """A slope reaches over a gap to the next voxel that is there."""
    assert equal(spark, gappy, name)


@pytest.fixture(scope="module")
def late(tmp_path_factory):
    """The first slices are missing, and the first line of others: slopes of voxels around edges are unknown there."""
    return table_of(tmp_path_factory.mktemp("late"), lambda t: t[~t.vec_id.isin([100, 150, 175])].assign(vec_id=lambda k: k.vec_id + 1025))


@pytest.mark.parametrize("name", ["lcc_derivatives", "lcc_derivatives_affine"])
def test_unknown_slopes_leave_out_their_derivatives_alone(spark, late, name):
    assert equal(spark, late, name)


@pytest.mark.parametrize("name", ["lcc_derivatives", "lcc_derivatives_affine"])
def test_derivatives_without_overlap_are_null(spark, tmp_path, name):
    folder, db = table_of(tmp_path, lambda t: t[t.vec_id < 60])
    assert equal(spark, (folder, db), name)
    assert catalog.QUERIES[name](spark, folder).first()["n"] == 0


def table_of(folder, change):
    change(pq.read_table("/root/testdata/sf0.1/embeddings.parquet").sort_by("vec_id").slice(0, LINES).to_pandas()).to_parquet(folder / "embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    return str(folder), db


@pytest.fixture(scope="module")
def unknown(tmp_path_factory):
    """Vectors that are null, short, or have a null: their lines are there, their grey values are not known."""

    def change(t):
        e = [v.tolist() for v in t.embedding]
        e[137], e[300], e[420][20] = None, e[300][:40], None
        return t.assign(embedding=e)

    return table_of(tmp_path_factory.mktemp("unknown"), change)


@pytest.mark.parametrize("name", ["voxelize_rescale", "edge_mask_chunked_fixed", "edge_mask_chunked_moving", "lcc_derivatives", "lcc_derivatives_affine"])
def test_unknown_grey_values_are_no_gaps(spark, unknown, name):
    folder, db = unknown
    df = catalog.QUERIES[name](spark, folder)
    got, want = df.collect(), db.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.SQL[name]})").fetchall()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert len(got) == len(want) and all(same(x, y) for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True) for x, y in zip(g, w, strict=True))


@pytest.mark.parametrize("name", ["lcc_derivatives", "lcc_derivatives_affine"])
def test_derivatives_of_an_empty_table_are_null(spark, tmp_path, name):
    pq.write_table(pq.read_table("/root/testdata/sf0.1/embeddings.parquet").slice(0, 0), tmp_path / "embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    assert equal(spark, (str(tmp_path), db), name)
