"""The shared folder of a session, for checkpoints and for files that every executor reads."""

from __future__ import annotations

import hashlib
import re
import tempfile

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one where it is unset and the master is local.

    On a cluster an unset folder is an error: a folder of one machine would lose or split what others read.
    """
    sc = spark.sparkContext
    named = sc.getConf().get(SETTING) or spark.conf.get(SETTING, None)
    if not named and not sc.getCheckpointDir() and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError(f"set {SETTING} to a folder that all machines share")
    if not named:
        named = sc.getCheckpointDir() or f"file://{tempfile.mkdtemp(prefix='veilspan-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def share_file(spark: SparkSession, content: bytes, stem: str) -> str:
    """Writes ``content`` to the shared folder and has every executor fetch it; returns its name for ``SparkFiles.get``.

    The name holds a digest of the content, so equal content is sent once and lost executors fetch it again.
    """
    name = f"{stem}-{hashlib.sha256(content).hexdigest()[:16]}.bin"
    sc = spark.sparkContext
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not files.exists(path):
        out = files.create(path, True)
        for at in range(0, len(content), 1 << 20):
            out.write(bytearray(content[at : at + (1 << 20)]))
        out.close()
    sc.addFile(files.makeQualified(path).toString())  # with its scheme: a bare path would be read from the driver's disk
    return name
