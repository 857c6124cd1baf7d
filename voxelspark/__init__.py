"""voxelspark: volumetric label data as relations of voxels, processed with Spark DataFrames."""
