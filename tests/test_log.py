import logging

import pytest
from pyspark.sql import functions as F

from leafmill import log
from leafmill.sources import extract as E


def test_log(spark, tmp_path):
    logger = log.configure(str(tmp_path / "logs"), "leafmill.tests")
    assert log.configure(str(tmp_path / "logs"), "leafmill.tests") is logger and len(logger.handlers) == 2

    @log.logged(logger)
    def works():
        return 7

    assert works() == 7
    with pytest.raises(ZeroDivisionError), log.step(logger, "breaks"):
        1 / 0
    written = next((tmp_path / "logs").iterdir()).read_text()
    assert "works: start" in written and "breaks: failed" in written
    df, watch = log.observed(spark.range(10), "count", even=F.col("id") % 2 == 0)
    assert df.count() == 10 or df.collect()
    assert watch.get["rows"] == 10
    logging.getLogger("leafmill.tests").handlers.clear()


def test_validate_pdfs(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n1 0 obj <</Type /Page>> endobj\n")
    (tmp_path / "b.pdf").write_bytes(b"no")
    (tmp_path / "c.pdf").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[-1]: r for r in E.validate_pdfs(E.read_files(spark, str(tmp_path))).collect()}
    assert (got["a.pdf"].is_pdf, got["a.pdf"].page_count, got["a.pdf"].likely_scanned) == (True, 1, True)
    assert not got["b.pdf"].is_pdf and got["b.pdf"].error and got["c.pdf"].empty
