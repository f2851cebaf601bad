"""Readmission label and cohort exclusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.joins import HOT_FLOOR, HOT_SHARE, spread_join

# Days between two admissions that count as a readmission; disposition "left against advice".
WINDOW_DAYS = 30
AGAINST_ADVICE = "7"


def readmission_label(
    encounters: DataFrame,
    key: str = "n",
    patient: str = "patient_id",
    admit: str = "admit",
    out: str = "label",
    days: int = WINDOW_DAYS,
    hot_share: float = HOT_SHARE,
    hot_floor: int = HOT_FLOOR,
) -> DataFrame:
    """1 when the patient's next admission (ordered by time, then key) starts at most ``days`` days later.

    The rows are first combined to one row per patient and day, so the window that finds the next active day holds at
    most one row per calendar day even for a patient id with a third of all rows. Within a day every encounter but the
    last has a successor. The join back to the encounters splits hot patient-days.
    """
    per_day = (
        encounters.select(F.col(patient), F.to_date(admit).alias("_day"), F.col(admit), F.col(key))
        .groupBy(patient, "_day")
        .agg(F.min(admit).alias("_first"), F.max(F.struct(admit, key)).alias("_last"))
    )
    by_day = Window.partitionBy(patient).orderBy("_day")
    per_day = per_day.select(patient, "_day", "_last", F.lead("_first").over(by_day).alias("_next"))
    dated = encounters.withColumn("_day", F.to_date(admit))
    joined = spread_join(dated, per_day, [patient, "_day"], [key], "left", hot_share, hot_floor)
    same_day = F.struct(admit, key) < F.col("_last")
    later = F.col("_next") <= F.col(admit) + F.expr(f"INTERVAL {days} DAYS")
    label = F.when(same_day | later, 1).otherwise(0)
    return joined.select(*encounters.columns, label.alias(out))


def exclude_disposition(encounters: DataFrame, column: str = "disposition", codes=(AGAINST_ADVICE,)) -> DataFrame:
    """Drop encounters that ended with one of the codes; encounters without a disposition stay."""
    return encounters.where(~F.coalesce(F.col(column).isin(*codes), F.lit(False)))
