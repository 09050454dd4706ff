"""Images from files: decoded in the JVM, limited in size, never guessed at."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 8 * 1024 * 1024
TOO_LARGE, UNSUPPORTED = "larger than the limit", "not an image that can be decoded"


def read_images(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(key, height, width, rgb, problem) for every file below ``path``; key is its location.

    A file of more than ``most`` bytes, or one that cannot be decoded, has a ``problem`` and
    no pixels. Grey images get equal channels, transparency is dropped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("key"), "length")
    fits = files.where(F.col("length") <= most)
    decoded = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path)
    # both sources write one and the same location in different ways
    place = lambda c: F.regexp_replace(c, "^file:/+", "/")
    decoded = decoded.select(place(F.col("image.origin")).alias("at_"), "image.height", "image.width", "image.nChannels", "image.data")

    def convert(batches):
        for batch in batches:
            out = []
            for h, w, n, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                x = np.frombuffer(data, np.uint8).reshape(h, w, n)
                out.append(np.ascontiguousarray(np.repeat(x, 3, axis=2) if n == 1 else x[:, :, 2::-1]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["at_", "height", "width", "rgb"])

    pixels = decoded.join(fits.select(place(F.col("key")).alias("at_")), "at_", "left_semi").mapInArrow(convert, "at_ string, height int, width int, rgb binary")
    out = files.withColumn("at_", place(F.col("key"))).join(pixels, "at_", "left")
    problem = F.when(F.col("length") > most, TOO_LARGE).when(F.col("rgb").isNull(), UNSUPPORTED)
    return out.select("key", "height", "width", "rgb", problem.alias("problem"))
