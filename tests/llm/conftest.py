"""Small frames for the training-data operators; the shared ``spark`` fixture is the parent's."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
