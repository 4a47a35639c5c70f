"""voxelbase: tomography analytics expressed as Spark DataFrame plans."""
