"""Linkloom: analytics over crawled web sites as plain Spark jobs.

``functions``  Column expressions (URLs, text, classification, cron shapes).
``sources``    Readers and writers: fetched pages, robots, sitemaps, state tables.
``operators``  DataFrame -> DataFrame jobs, one module per area.
``plans``      Ways of ordering and slicing big groups, and the whole refresh job.
``streaming``  Structured Streaming versions of the feeds.
"""
