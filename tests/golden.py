"""Golden 66-point national yield series, 1959..2024 (fixture data)."""

GOLDEN_YEARS = list(range(1959, 2025))
GOLDEN_VALUES = [
    3382, 3423, 3411, 3726, 3968, 4098, 4255, 4322, 4537, 4425, 4318, 4618, 4718, 4700, 4274, 4440, 4558, 4663,
    4412, 4484, 4599, 4413, 4819, 4710, 4598, 4954, 5414, 5651, 5555, 5514, 5749, 5529, 5731, 5736, 5510, 5964,
    5621, 6120, 5897, 5663, 5866, 6281, 6496, 6578, 6670, 6988, 6624, 6898, 7219, 6846, 7085, 6725, 7067, 7463,
    7694, 7576, 7472, 7237, 7507, 7692, 7474, 7620, 7710, 7385, 7641, 7748,
]


def golden_points(spark):
    rows = [("U.S. TOTAL", "ALL CLASSES", y, float(v)) for y, v in zip(GOLDEN_YEARS, GOLDEN_VALUES)]
    return spark.createDataFrame(rows, "LOCATION_DESCRIPTION string, CLASS_DESCRIPTION string, x int, y double")
