"""Spark-native analysis of satellite thermal detections.

Every public function takes and returns DataFrames; nothing here pulls row data to the driver.
"""
