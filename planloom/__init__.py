"""planloom: a PySpark-native engine for command/plan datasets.

Everything is DataFrame in, DataFrame out.  Sub-packages:

* ``functions``  - Column-level functions (goal parsing, text normalisation, ...)
* ``operators``  - DataFrame operators (validation, dedup, balance, scoring, ...)
* ``sources``    - readers and writers (JSON lines, Markdown catalogs, reports)
* ``plans``      - named end-to-end queries with their SQL oracles
* ``streaming``  - the row-local operators and keyed dedup on unbounded input
"""
