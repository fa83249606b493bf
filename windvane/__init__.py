"""windvane: early-fault analytics for turbine sensor time series, on Spark DataFrames.

``functions``  column expressions (no jobs, no shuffles)
``operators``  DataFrame -> DataFrame transformations
``sources``    readers and writers
``plans``      end-to-end jobs built from the operators
"""
