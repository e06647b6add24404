"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# The fields of a task record.
TASK_FIELDS = [
    "task_id",
    "prompt",
    "canonical_solution",
    "incorrect_solution",
    "entry_point",
    "test_setup",
    "test",
    "language",
    "difficulty",
    "domain",
    "description",
]
# Languages with a renderer; the match is exact.
LANGUAGES = ["Python", "C++", "Java", "JavaScript"]
# Solution variants, their short names and field names.
VARIANTS = {"ir": "canonical_solution", "incs": "incorrect_solution"}
# Implementation targets of a C++ task.
CPP_TARGETS = ["A", "B", "C", "base", "ideal", "incorrect"]
# Cohorts of single-letter files as (name, first letter, last letter).
COHORTS = [("first", "A", "E"), ("second", "F", "J")]
# Fixed value: seconds a program may run.
RUN_LIMIT_S = 5.0

TASKS = T.StructType([T.StructField(name, T.StringType()) for name in TASK_FIELDS])

NOTEBOOK_CELLS = T.StructType(
    [
        T.StructField("notebook", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("cell_type", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

# The metadata fields of a task folder.
TASK_METADATA_FIELDS = [
    "time_to_develop_prompt",
    "programming_language",
    "task_type",
    "difficulty",
    "estimated_skill_requirements",
    "user_prompt",
]
TASK_METADATA = T.StructType([T.StructField(name, T.StringType()) for name in TASK_METADATA_FIELDS])

# Counters of a coverage report.
JACOCO_KINDS = ["instruction", "branch", "line"]
JACOCO_COUNTERS = [f"{kind}_{side}" for kind in JACOCO_KINDS for side in ("missed", "covered")]

JEST_REPORT = (
    "numPassedTests INT, numTotalTests INT, "
    "testResults ARRAY<STRUCT<status: STRING, assertionResults: "
    "ARRAY<STRUCT<title: STRING, status: STRING, failureMessages: ARRAY<STRING>>>>>"
)
