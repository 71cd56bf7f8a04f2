"""Training-data operators: one module per operator, nothing else imports them."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
