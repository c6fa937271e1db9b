"""Session set-up: adaptive execution, UTC and a reliable checkpoint folder."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "pagemill", cpus: int | None = None, checkpoint_dir: str | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; clusters bring their own session."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = (
        SparkSession.builder.master(f"local[{n}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if checkpoint_dir:
        b = b.config("spark.checkpoint.dir", f"file://{os.path.abspath(checkpoint_dir)}")
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s
