"""Rules, their compiler and driver-side rule learning."""
