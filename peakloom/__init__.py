"""peakloom: weighted point clustering and corpus preparation on Spark DataFrames."""
