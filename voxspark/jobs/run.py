"""From a configuration file to results: import of two to four images, registration, and files for other programs."""

from __future__ import annotations

import configparser
import hashlib
import io
import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import ImageMeta, voxel_matrix
from ..operators.lcc import Chunks, chunked
from ..operators.pointwise import difference
from ..operators.resample import linear_chunks
from ..sources import mhd, store
from .export import matrix_text, moved_header, read_matrix, run_record, validation_text
from .pyramid import build_pyramid, level_metas
from .register import Config, Registration, States, initial_matrix, pyramid_plan, read_config, register

ROLES = ("fixed", "moving", "fixed_mask", "moving_mask")


@dataclass(frozen=True)
class Job:
    """What a configuration says beside the registration's own parameters."""

    config: Config
    images: dict[str, str]
    bits: dict[str, int | None]
    ranges: dict[str, tuple[float, float] | None]
    working: str
    output: str
    reuse: bool
    initial: str | None
    as_ras: bool
    resample: bool
    validation: bool


def _name(ini: configparser.ConfigParser, section: str, key: str) -> str | None:
    value = ini.get(section, key, fallback="None").strip()
    return None if value in ("", "None") else value


def _parsed(text: str) -> configparser.ConfigParser:
    ini = configparser.ConfigParser(interpolation=configparser.ExtendedInterpolation())
    ini.read_string(text)
    return ini


def read_job(text: str) -> Job:
    """Typed values; nothing is executed. Images named `None` are absent, and both a fixed and a moving one are needed."""
    ini = _parsed(text)
    images = {r: n for r in ROLES if (n := _name(ini, "DEFAULT", f"{r}_image_name"))}
    if missing := {"fixed", "moving"} - images.keys():
        raise ValueError(f"no image is named for: {', '.join(sorted(missing))}")
    bits: dict = {r: ini.getint("compression", f"{r}_image_bits_per_pixel", fallback=10) for r in ("fixed", "moving")}
    if any(not 1 <= b <= 14 for b in bits.values()):
        raise ValueError("grey values need 1 to 14 bits")
    ranges: dict = {}
    for r in ("fixed", "moving"):
        given = _name(ini, "masking", f"{r}_grey_masking_range")
        ranges[r] = tuple(float(x) for x in given.split()) if given else None
        if given and len(ranges[r]) != 2:
            raise ValueError("a grey range has two numbers")
    flag = lambda section, key: ini.getboolean(section, key, fallback=False)
    return Job(
        read_config(text), images, bits, ranges, ini.get("DEFAULT", "working_directory_name", fallback="work"), ini.get("DEFAULT", "output_directory_name", fallback="output"),
        flag("DEFAULT", "reuse_existing_input_images"), _name(ini, "transformation", "initial_transformation_file_name"), flag("transformation", "store_as_RAS"),
        flag("output", "resample_moving_image"), flag("output", "store_RIRE_validation_file"),
    )


def import_images(spark: SparkSession, job: Job) -> dict[str, tuple[ImageMeta, DataFrame]]:
    """Every named image, imported into the store of the working folder, or as it lies there if it may be used again."""
    out = {}
    for role, path in job.images.items():
        if not (job.reuse and store.has_image(spark, job.working, role)):
            mask = role.endswith("_mask")
            meta, rows = mhd.import_image(spark, path, job.bits.get(role), job.ranges.get(role), mask)
            store.save_image(spark, job.working, role, rows, meta, 1 if mask else job.bits[role], mhd.read_header(path), [f"imported from {path}"])
        out[role] = store.open_image(spark, job.working, role)
    return out


def stored_pyramids(spark: SparkSession, job: Job, images: dict[str, tuple[ImageMeta, DataFrame]]) -> dict[str, list[Chunks]]:
    """The pyramids of images and masks, which are kept in the store of the working folder and used again where their levels are the same."""
    plan, out = pyramid_plan(images["fixed"][0], images["moving"][0], job.config), {}
    for role, (meta, _) in images.items():
        name, metas = f"{role}_pyramid", level_metas(meta, plan)
        known = store.stored(spark, job.working, name) if job.reuse and store.has_image(spark, job.working, name) else None
        if known is None or (known.meta, *known.levels) != tuple(metas):
            base = store.stored(spark, job.working, role)
            levels = build_pyramid(store.open_level(spark, job.working, role), meta, plan, role.endswith("_mask"), keep=True)
            store.save_pyramid(spark, job.working, name, levels, base.bits, base.header, [*base.log, f"{len(levels)} levels"])
            for c in levels[1 if metas[0] == meta else 0 :]:
                c.rows.unpersist()
        out[role] = store.open_pyramid(spark, job.working, name)
    return out


def resampled_moving(spark: SparkSession, fixed_path: str, moving_path: str, matrix: np.ndarray) -> tuple[DataFrame, ImageMeta, str]:
    """The moving file's own values on the fixed file's grid and in its element type: rounded and held within its range, 0 outside."""
    f = mhd.meta_of(mhd.read_header(fixed_path))
    m, moving = mhd.read_mhd(spark, moving_path)
    element = mhd.read_header(fixed_path)["ElementType"]
    chunks = chunked(moving.select("z", "y", "x", F.col("g").alias("v")), m, 0, kind="<f8")
    return linear_chunks(f, chunks, voxel_matrix(f, m, matrix), mhd.value_limits(element)), f, element


def validation_header(text: str) -> str:
    """The configured header, with date, modalities and patient number filled in."""
    ini = _parsed(text)
    if not ini.has_section("output"):
        return ""
    get = lambda key: ini.get("DEFAULT", key, fallback="")
    own = {"RIRE_date": time.strftime("%d %B %Y"), "RIRE_from": get("fixed_modality").upper(), "RIRE_to": get("moving_modality"), "RIRE_patient_number": get("patient_id")[-3:]}
    for k, v in own.items():
        ini.set("output", k, v)
    return ini.get("output", "RIRE_header", fallback="")


def export_results(spark: SparkSession, text: str, job: Job, fixed: ImageMeta, result: Registration) -> dict[str, str]:
    """Writes what the configuration asks for into the output folder, and returns each file's name and path."""
    ini, out = _parsed(text), {}

    def put(name: str, content: str) -> None:
        out[name] = f"{job.output}/{name}"
        mhd.write_text(out[name], content)

    put("result.mat", matrix_text(result.matrix, job.as_ras))
    ini.read_dict({"result": {"lcc": repr(float(result.lcc)), "p": " ".join(repr(float(x)) for x in result.p)}})
    dump = io.StringIO()
    ini.write(dump)
    put("result.ini", dump.getvalue())
    put("result.json", run_record(result))
    if not job.config.affine:
        put("moved_header.mhd", moved_header(job.images["moving"], result.matrix))
    if job.resample:
        rows, meta, element = resampled_moving(spark, job.images["fixed"], job.images["moving"], result.matrix)
        out["resampled_moving_image.mhd"] = f"{job.output}/resampled_moving_image.mhd"
        mhd.write_mhd(rows, meta, out["resampled_moving_image.mhd"], element)
    if job.validation:
        get = lambda key: ini.get("DEFAULT", key, fallback="")
        put(f"RIRE_{get('patient_id')}_{get('modality_combination')}.transformation", validation_text(fixed, result.matrix, validation_header(text)))
    return out


def run(spark: SparkSession, path: str) -> tuple[Registration, dict[str, str]]:
    """The whole job of a configuration file; paths in it are taken as they stand. Where images may be used again, so are the levels that an earlier run with this configuration has finished."""
    text = mhd.read_text(path)
    job = read_job(text)
    images = import_images(spark, job)
    given = read_matrix(mhd.read_text(job.initial)) if job.initial else None
    f, m = images["fixed"][0], images["moving"][0]
    initial_matrix(given, job.config)  # so that a wrong setting is told before any work
    levels = stored_pyramids(spark, job, images)
    masks = [(images[r][0], levels[r]) if r in images else None for r in ("fixed_mask", "moving_mask")]
    name = hashlib.sha256(repr((text, None if given is None else given.tolist())).encode()).hexdigest()[:32]
    states = States(spark, job.working, name) if job.reuse else None
    result = register(levels["fixed"], f, levels["moving"], m, job.config, given, *masks, states)
    return result, export_results(spark, text, job, f, result)


def difference_files(spark: SparkSession, a: str, b: str, out: str, absolute: bool = True) -> None:
    """Writes a - b, or its magnitude, with a's geometry and in its element type; sizes have to agree. Whole numbers wrap as that type does."""
    fa, fb = mhd.read_header(a), mhd.read_header(b)
    if fa["DimSize"].split() != fb["DimSize"].split():
        raise ValueError(f"the images' sizes differ: {fa['DimSize']} and {fb['DimSize']}")
    (meta, left), (_, right) = (mhd.read_mhd(spark, p) for p in (a, b))
    rows = difference(left.withColumnRenamed("g", "v"), right.withColumnRenamed("g", "v"), absolute)
    if (limits := mhd.value_limits(fa["ElementType"])) is not None:
        span = limits[1] - limits[0] + 1
        rows = rows.withColumn("v", F.expr(f"pmod(cast(v as decimal(38,0)) - {limits[0]}, {span}) + {limits[0]}"))
        rows = rows.withColumn("v", F.col("v").cast("decimal(20,0)" if limits[1] >= 1 << 63 else "long"))
    mhd.write_mhd(rows, meta, out, fa["ElementType"])
