"""Settings in log lines by task type."""

from tracelake.operators import settings

KEPT = [
    ("SPARK", "  --conf spark.x=1"), ("spark", '"mainClass" : "a.B"'), ("SPARK_APP", "spark.memory: 4g"), ("FLINK", "flink run -c x"), ("FLINK", "taskmanager.memory.process.size: 4096"),
    ("DATAX", '"channel": 3'), ("PYTHON", "import pandas"), ("SHELL", "/opt/a.sh"), ("API", "GET https://x/y"), ("SQL", "select 1"), ("HIVE", "set hive.x=1"), ("SUB_PROCESS", '"tenantCode": 1'),
    ("DEPENDENT", '"cycle": "day"'), (None, "yarn.address=1"), ("OTHER", "bash x"),
]
LEFT_OUT = [
    ("SPARK", "flink run x"), ("SPARK", "at org.x.Y.run(Y.java)"), ("SPARK", "--conf spark.x=1 SparkException"), ("SPARK", "spark.scheduler.x=1"), ("FLINK", "state of things"), ("PYTHON", "x = 1"),
    ("SQL", "x SELECT 1"), (None, "spark.memory=4"), ("OTHER", "--executor-memory 4G"), ("SQL", ""), ("SQL", None), ("HTTP", '"url": Error'),
]


def test_lines_are_chosen_by_type(spark):
    rows = [(f"l{k}", kind, k, line) for k, (kind, line) in enumerate(KEPT + LEFT_OUT)]
    df = spark.createDataFrame(rows, "log_id string, task_type string, line_no int, line string")
    assert sorted((r.line_no, r.line) for r in settings.setting_lines(df).collect()) == [(k, line.strip()) for k, (_, line) in enumerate(KEPT)]
