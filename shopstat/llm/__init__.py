"""Operations of a training-data pipeline; each module is one operator.

``queries.py`` registers them for the driver.  Nothing outside this
subpackage (and ``corpus_pipeline.py``) imports it.
"""
