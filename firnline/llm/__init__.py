"""Operators for training corpora."""

import pyarrow as pa

# Python workers outlive their tasks. What their batches took goes back to the system, not to a pool that keeps it.
pa.set_memory_pool(pa.system_memory_pool())
