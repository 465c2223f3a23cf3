from __future__ import annotations

import os

# tests run a worker per core: matrix libraries with threads of their own would fight for them
os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
