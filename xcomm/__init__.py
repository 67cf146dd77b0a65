"""xcomm: cross-community pointer ("referral") analytics as Spark DataFrame operators.

Every public operator takes DataFrames and returns a DataFrame; the work runs on Spark's
joins, aggregations, windows and ML estimators.  Sub-packages:

- ``sources``   — table loading / writing, fixed schemas, resumable result cells
- ``functions`` — column expressions (mention parsing, tokens, time features)
- ``operators`` — relational operators (labelling, as-of history, similarity, folds, metrics, models)
- ``plans``     — end-to-end plans and the fixture queries registered for verification
- ``streaming`` — intentionally empty: the analysed workload has no streaming part
"""

__version__ = "0.1.0"
