"""riskframe: credit-risk style profiling, exploration, feature preparation,
a class-weighted linear SVM with calibrated probabilities, evaluation and
applicant scoring, as Spark DataFrame jobs.

Entry points:

* ``riskframe.plans.queries.QUERIES[name](spark, source)`` -- every output as
  a lazy DataFrame; ``source`` is an application CSV, a Parquet table of
  applications or a folder of the TPC-H-style test tables
  (``riskframe.plans.context.load_applications``);
* ``riskframe.plans.report.run_report(spark, source, out_dir)`` -- all of
  them written as Parquet (``scripts/report.py`` for spark-submit);
* ``riskframe.streaming.scoring`` -- applicant scoring on a stream.
"""
