"""Tooth numbering: the static chart and column expressions over two-digit tooth numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The class list of the tooth model and the chart's viewer order.
RESTORATIONS = ("bridge", "crown", "implant")
POSITIONS = ("central_incisor", "lateral_incisor", "canine", "first_premolar", "second_premolar", "first_molar", "second_molar", "third_molar")
QUADRANTS = {1: ("upper", "right"), 2: ("upper", "left"), 3: ("lower", "left"), 4: ("lower", "right")}
LESIONS = ("Cavities", "Damage", "Infection", "Wisdom")

ALL_FDI = [10 * q + p for q in QUADRANTS for p in range(1, 9)]
VIEWER_ORDER = [10 * q + p for left, right in ((1, 2), (4, 3)) for q, ps in ((left, range(8, 0, -1)), (right, range(1, 9))) for p in ps]


def anatomy_name(fdi: int) -> str:
    arch, side = QUADRANTS[fdi // 10]
    return f"{arch}_{side}_{POSITIONS[fdi % 10 - 1]}"


def class_rows() -> list[tuple[int, str, int | None, str, str]]:
    """(class_id, name, fdi, type, label), restorations first."""
    rows = [(i, n, None, "restoration", n.capitalize()) for i, n in enumerate(RESTORATIONS)]
    return rows + [(len(RESTORATIONS) + i, anatomy_name(f), f, "tooth", f"T{f}") for i, f in enumerate(ALL_FDI)]


def class_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(class_rows(), "class_id int, name string, fdi int, type string, label string")


def quadrant(fdi: Column) -> Column:
    return F.floor(fdi / 10).cast("int")


def position(fdi: Column) -> Column:
    return (fdi % 10).cast("int")


def arch(fdi: Column) -> Column:
    return F.when(quadrant(fdi).isin(1, 2), "upper").when(quadrant(fdi).isin(3, 4), "lower")


def patient_side(fdi: Column) -> Column:
    return F.when(quadrant(fdi).isin(1, 4), "right").when(quadrant(fdi).isin(2, 3), "left")


def viewer_side(fdi: Column) -> Column:
    """The half of the image: the mirror of the patient's side."""
    return F.when(patient_side(fdi) == "right", "left").when(patient_side(fdi) == "left", "right")


def tooth_type(fdi: Column) -> Column:
    p = position(fdi)
    return F.when(p.isin(1, 2), "incisor").when(p == 3, "canine").when(p.isin(4, 5), "premolar").when(p.isin(6, 7, 8), "molar")


def chart_slots(spark: SparkSession) -> DataFrame:
    """The 32 slots with their place in viewer order, left to right, upper row first."""
    base = spark.createDataFrame([(f, anatomy_name(f), i) for i, f in enumerate(VIEWER_ORDER)], "fdi int, anatomy string, slot int")
    f = F.col("fdi")
    return base.select("fdi", "anatomy", "slot", quadrant(f).alias("quadrant"), position(f).alias("position"), arch(f).alias("arch"), patient_side(f).alias("patient_side"), viewer_side(f).alias("viewer_side"), tooth_type(f).alias("tooth_type"), (position(f) == 8).alias("is_third_molar"))


def fdi_from_class_name(name: Column) -> Column:
    """T26 -> 26; null for anything but a tooth of the chart."""
    n = F.when(name.rlike("^T[0-9]{2}$"), F.substring(name, 2, 2).cast("int"))
    return F.when(n.isin(ALL_FDI), n)


def humanise_anatomy(anatomy: Column, fdi: Column) -> Column:
    """Words of an anatomy name in title case, or a name made from the number."""
    names = F.array(*[F.lit(p.replace("_", " ").title()) for p in POSITIONS])
    made = F.concat_ws(" ", F.initcap(arch(fdi)), F.initcap(patient_side(fdi)), F.try_element_at(names, position(fdi)))
    return F.when(anatomy.isNotNull() & (anatomy != ""), F.initcap(F.replace(anatomy, F.lit("_"), F.lit(" ")))).otherwise(made)
