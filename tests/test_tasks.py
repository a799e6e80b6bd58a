import threading
import time

import pytest
from pyspark.sql import functions as F

from quarry import tasks


def test_progress_of_a_task(spark):
    with tasks.task(spark, "counting"):
        assert spark.range(1000).repartition(3).count() == 1000
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    found = tasks.progress(spark, "counting")
    assert found.jobs > 0 and found.running == found.failed == 0 and found.done > 0
    assert tasks.progress(spark, "nothing") == tasks.Progress(0, 0, 0, 0, 0)


def test_a_cancelled_task_ends(spark):
    def stop():
        for _ in range(200):
            if tasks.progress(spark, "endless").running:
                break
            time.sleep(0.1)
        tasks.cancel(spark, "endless")

    watch = threading.Thread(target=stop)
    watch.start()
    with pytest.raises(Exception, match="(?i)cancel"), tasks.task(spark, "endless"):
        spark.range(1 << 40).select(F.sum(F.hash("id"))).collect()
    watch.join()
    assert spark.range(3).count() == 3
