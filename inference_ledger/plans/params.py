"""Fixed parameters of the registered queries.

Time filters never read the clock inside a query: every time-bounded query takes
an explicit ``as_of``. The test tables span 2024-01-01 .. 2024-01-30, so the
registered queries use midnight after the last day.
"""

# fixed values
AS_OF_EPOCH = 1706659200.0          # 2024-01-31 00:00:00 UTC
AS_OF_TEXT = "2024-01-31 00:00:00"
RECENT_LIMIT = 50                   # recent-logs API default page size
RECENT_OFFSET = 0
DEEP_OFFSET = 640                   # a page many dates back
LOG_PAGE_LIMIT = 10                 # rendered log page default
SYSTEM_LOG_LIMIT = 50               # system-log API default
SYSTEM_LOG_PAGE_LIMIT = 20          # rendered system-log page default
ROUND_DIGITS = 6                    # averages are compared after rounding
