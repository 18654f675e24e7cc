"""blockscope: Spark jobs for block-chain telemetry (blobs, arrivals, tips, payments, reorgs).

Everything is DataFrame in, DataFrame out.  ``operators`` holds the generic
building blocks (column names are parameters), ``plans`` the named analyses
built from them, ``sources`` the batch landing jobs, ``streaming`` the
incremental ones.
"""
