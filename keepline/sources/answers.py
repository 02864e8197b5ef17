"""Answers to prompts, kept as they come: what has been answered is never asked again."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The column that tells a half-written line from an answer.
_DAMAGED = "_damaged"


def read_answers(spark: SparkSession, path: str, key: str, kind: str = "string", out: str = "text") -> DataFrame:
    """(key, text) of all answers so far, one per key; half-written lines are skipped, a missing folder is empty."""
    schema = f"`{key}` {kind}, `{out}` string"
    try:
        lines = spark.read.schema(f"{schema}, {_DAMAGED} string").option("columnNameOfCorruptRecord", _DAMAGED).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise
    good = lines.where(F.col(_DAMAGED).isNull() & F.col(f"`{key}`").isNotNull() & F.col(f"`{out}`").isNotNull())
    return good.groupBy(key).agg(F.max(out).alias(out))


def _asker(path: str, key: str, out: str, make_writer: Callable[[], Callable[[str], str]]):
    """The work of one task, made here so that it travels to executors by value."""

    def ask(batches: Iterator[pd.DataFrame], task: str, attempt: int) -> Iterator[pd.DataFrame]:
        import json

        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(path)
        files.create_dir(folder, recursive=True)
        # What earlier attempts of this task have answered before they were lost.
        had = set()
        for info in files.get_file_info(fs.FileSelector(folder)):
            if info.base_name.startswith(f"task-{task}-"):
                with files.open_input_stream(info.path) as stream:
                    for line in stream.read().decode(errors="replace").splitlines():
                        try:
                            had.add(json.loads(line)[key])
                        except (ValueError, KeyError, TypeError):
                            continue
        writer, stream = None, None
        try:
            for batch in batches:
                asked = 0
                for k, prompt in zip(batch[key].tolist(), batch["prompt"]):
                    if k in had:
                        continue
                    if stream is None:
                        writer = make_writer()
                        stream = files.open_output_stream(f"{folder}/task-{task}-{attempt}.json")
                    stream.write(json.dumps({key: k, out: writer(prompt)}).encode() + b"\n")
                    stream.flush()
                    had.add(k)
                    asked += 1
                yield pd.DataFrame({"asked": [asked]})
        finally:
            if stream is not None:
                stream.close()

    return ask


def answer(
    prompts: DataFrame, key: str, path: str, make_writer: Callable[[], Callable[[str], str]], tasks: int = 64, out: str = "text"
) -> DataFrame:
    """Ask a caller-supplied writer for every prompt that has no answer under ``path`` yet; returns all answers.

    Each answer is appended to the task's own file as soon as it comes. A task that is tried again, and a
    job that is started again, leave out what is there: only the prompt being answered at the
    moment of a loss is asked twice. ``path`` must be one that pyarrow can write to from every executor
    (a shared folder, HDFS); an object store keeps a file only once it is closed, so there a lost
    task asks its own prompts again. Prompts without a key are left out, a key's prompts are asked once.
    Speculative copies of a task would ask twice: leave ``spark.speculation`` off.
    """
    spark, kind = prompts.sparkSession, prompts.schema[key].dataType.simpleString()
    ask, run = _asker(path, key, out, make_writer), uuid.uuid4().hex[:12]
    left = prompts.where(F.col(key).isNotNull()).select(key, "prompt")
    left = left.join(read_answers(spark, path, key, kind, out).select(key), key, "left_anti")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        yield from ask(batches, f"{run}-{context.partitionId()}", context.taskAttemptId())

    # Dealt by key, so that another attempt of a task has the same prompts.
    left.repartition(tasks, F.col(key)).mapInPandas(work, "asked long").agg(F.sum("asked")).collect()
    return read_answers(spark, path, key, kind, out)
