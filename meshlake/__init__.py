"""meshlake: labelled spatial arrays, meshes and text corpora as Spark DataFrames."""
