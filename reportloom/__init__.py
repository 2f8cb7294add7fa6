"""Table linking and reporting on Spark DataFrames.

Every public function takes and returns ``DataFrame`` (or ``Column``) objects
and leaves physical planning to Catalyst.
"""
