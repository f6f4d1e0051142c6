"""slicewright: a Spark-native engine for image-annotation data.

Manifests, geometry, prompts, masks, scores and selection state are DataFrames;
every operator is a function from DataFrames to a DataFrame.
"""

__version__ = "0.1.0"
