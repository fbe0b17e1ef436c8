"""Values shared by the test modules (a module of its own: ``conftest`` names clash between test folders)."""

import datetime as dt

SF_SMALL = "/root/testdata/sf0.001"
AS_OF = dt.date(2001, 12, 31)
