import pytest

from eventscope.llm.frames import small_batches


@pytest.fixture
def write_tables(spark, tmp_path):
    """Writes rows as the driver's tables, in several files; columns without values are null."""
    small_batches(spark)
    made = [0]

    def write(**tables):
        made[0] += 1
        folder = tmp_path / f"tables-{made[0]}"
        for name, (rows, schema) in tables.items():
            width = schema.count(",") + 1
            rows = [tuple(r) + (None,) * (width - len(r)) for r in rows]
            spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return write
