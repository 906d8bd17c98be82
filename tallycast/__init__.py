"""Payment-ledger forecasting as Spark DataFrame transformations.

Every operator is a function ``DataFrame -> DataFrame`` over an ``entity`` column, so the same plan
serves one entity, a list of entities, or the whole ledger, and composes with ``df.transform``.
"""
