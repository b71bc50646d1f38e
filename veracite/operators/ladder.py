"""Which reads of a URL count: the ladder of rungs, climbed until one is readable.

Reads of all rungs are rows; a window over each URL's few rows says which ones a
climber would have made. A URL that is a PDF takes the PDF rung alone; an HTML
rung that answers with a PDF sends the climber to the PDF rung, where it stops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url
from .signals import header_values

HTML_RUNGS = ("node", "curl")
PDF_RUNG = "pdftotext"


def read_ord(reads: DataFrame) -> Column:
    """The order of several reads of one URL by one rung, where ``reads`` has ``read_ord``."""
    return F.col("read_ord") if "read_ord" in reads.columns else F.lit(0).cast("long")


def attempted(reads: DataFrame, exhaustive: bool = False) -> DataFrame:
    """Add ``attempted``; ``reads`` has signals. ``exhaustive`` climbs past readable rungs."""
    order = Window.partitionBy("url").orderBy(F.when(F.col("rung") == PDF_RUNG, 1).otherwise(0), "rung_ord", read_ord(reads)).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("url")
    pdf_url = url.is_pdf(F.col("url"))
    html = F.col("rung") != PDF_RUNG
    answers_pdf = html & F.exists(header_values(F.col("headers"), "content-type"), lambda v: v.rlike("(?i)application/pdf"))
    has_pdf_rung = F.max((F.col("rung") == PDF_RUNG).cast("int")).over(whole) == 1
    reroutes = answers_pdf & has_pdf_rung
    stops = reroutes if exhaustive else reroutes | F.col("readable")
    stopped = F.coalesce(F.max((html & stops).cast("int")).over(order), F.lit(0)) == 1
    climbed = html & ~stopped
    step = reads.withColumn("_reroutes", reroutes).withColumn("_climbed", climbed)
    rerouted = F.max((F.col("_climbed") & F.col("_reroutes")).cast("int")).over(whole) == 1
    taken = F.when(pdf_url, ~html).when(html, F.col("_climbed")).otherwise(rerouted)
    return step.withColumn("attempted", taken).drop("_reroutes", "_climbed")


def ladder_truncated(rungs: Column, is_pdf: Column) -> Column:
    has = lambda r: F.array_contains(rungs, r)
    return F.when(is_pdf, ~has(PDF_RUNG)).otherwise(~(has("node") & has("curl")))


def has_untried_rung(tried: Column, available: Column, is_pdf: Column) -> Column:
    """Whether a further HTML rung could still be climbed."""
    html = F.array(*[F.lit(r) for r in HTML_RUNGS])
    untried = F.size(F.array_except(F.array_intersect(html, available), tried)) > 0
    return ~is_pdf & ~F.array_contains(tried, PDF_RUNG) & untried
