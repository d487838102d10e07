"""dyadic: screening pairs of items against a catalogue of outcomes, on Spark.

Sub-packages:

* ``sources``   -- readers for the input tables and the writers for results.
* ``functions`` -- column expressions (labels, gaps, formats, activations).
* ``operators`` -- reusable DataFrame operators (reshape, joins, sampling,
  metrics, ordered scans, scoring kernels, fits, analysis).
* ``plans``     -- composite jobs: evaluate, calibrate, screen, signature,
  profile prediction.
* ``streaming`` -- the screen as a Structured Streaming job.
"""

__version__ = "0.1.0"
