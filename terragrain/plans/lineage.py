"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's own.

    One is made only for a local master where neither is set, as in tests; on
    a cluster a folder of the driver's disk would not be shared.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    have = context._jsc.sc().getCheckpointDir()
    if not have.isDefined():
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="terragrain-"))
        have = context._jsc.sc().getCheckpointDir()
    return (named or have.get()).rstrip("/")


#: The greatest estimate of a table's bytes that is kept.
MOST = 1 << 62


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there.

    A checkpoint keeps what its plan was known by: the estimated size, a
    product over all joins, and constraints that hold the expression of each
    column.  Over many steps these grow to numbers of millions of digits and
    expressions without end, on the driver, so a size beyond ``MOST`` is taken
    as unknown and the constraints are left out.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    jvm, plan = df.sparkSession._jvm, out._jdf.queryExecution().logical()
    stats, none = plan.stats(), jvm.scala.Option.empty()
    known = jvm.scala.Option.apply(stats) if int(stats.sizeInBytes()) <= MOST else none
    session = out._jdf.sparkSession()
    bare = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none, session, known, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, bare), df.sparkSession)
