"""Vector quantization, lossless code compression and top-k search on Spark DataFrames."""
