"""lectern: study-guide analytics on Spark.

Sub-packages:

* ``functions``  Column expressions (text cleaning and tokenising, HTML, labels)
* ``sources``    table readers, adapters, file scan and routing, notifications, uploads
* ``operators``  DataFrame -> DataFrame operators (segment, layout, vocabulary,
                 summaries, keyed tables, study guide, product features, joins)
* ``plans``      composed plans, the query catalog and the DuckDB oracle
* ``streaming``  Structured Streaming jobs

Entry points: ``lectern.session.build_session`` for local runs and
``lectern.plans.catalog.queries()`` for the registered queries.
"""
