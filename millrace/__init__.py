"""millrace: data-processing operators for activity data, expressed as PySpark DataFrame plans.

Operators are pure ``DataFrame -> DataFrame`` functions.  I/O and state live in
``sources`` and ``flow`` only.
"""

__version__ = "0.1.0"
